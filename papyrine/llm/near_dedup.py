"""MinHash near-deduplication by an inverted join over signature coordinates.

A document's signature has one minimum for each of COORDINATES hash functions; each (coordinate, value) is a posting
list. Lists are ordered from rare to common; two documents that collide MATCHES times must share one of the first
COORDINATES - MATCHES + 1 entries of their signatures (prefix), so only those are posted and the common lists at the end
are skipped. Pairs of a list are counted on whole signatures, those with enough collisions confirmed on whole sets.

No list is expanded into all of its pairs: each is first compared with its most central document, and what that links is
one component and needs no further pairs. Documents of lists that still have several components are posted once more,
under the rarest quarter of their whole shingle sets; there a document takes part only where the number of its shingles
that others have allows a link at all. After a second turn with centres, pairs of different components whose sizes and
places in both prefixes allow a link are compared where a list is short. A longer list is dealt in blocks, and a task merges
the posting lists of two blocks' whole sets, counts what documents have in common and hands on the links of a forest alone:
so what is emitted grows with the documents, not with their pairs. Nothing is capped and both prefixes are exact, so no pair
is lost.
Documents with equal shingle sets are one class from the start, and only its smallest id takes part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import Scratch, joined_by_share, slices
from papyrine.llm.components import components
from papyrine.llm.shingles import mix, shingle_sets

#: Coordinates of a signature and collisions of a candidate. Documents at similarity 0.75 collide less often than
#: MATCHES with a chance of about one in 10**8.
COORDINATES, MATCHES = 64, 28
#: A class with more than one in HOT of all rows is joined by broadcast: there are fewer than HOT such classes.
HOT = 1000
#: Documents of a list that is compared by pairs, and of a block of a longer list.
FEW, BLOCK = 8, 256
#: A link is at least this many hundredths of shared shingles.
PERCENT = 75

_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
_TAGS = (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)).astype(np.int64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate-tagged minima of a non-empty set, as signed 64-bit numbers."""
    low = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(shingles), 4096):
        low = np.minimum(low, np.multiply.outer(_FACTORS, shingles[a : a + 4096]).min(axis=1))
    return _TAGS | (low >> np.uint64(32)).astype(np.int64)


def _sign(batches):
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(part["text"].to_list())
            key = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            key2 = [int((mix(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)).astype(np.int64)) for s in sets]
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_shingles": [len(s) for s in sets], "key": key, "key2": key2, "sig": [signature(s) if len(s) else np.zeros(0, np.int64) for s in sets]})


def _sets(batches):
    for batch in batches:
        for part in slices(batch):
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "shingles": [s.view(np.int64) for s in shingle_sets(part["text"].to_list())]})


def _unequal(lists: DataFrame, token: str) -> DataFrame:
    """The lists whose documents aren't one component yet, with their smallest document's size."""
    found = lists.groupBy(token).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n_shingles").alias("least"))
    return found.filter("lo < hi").select(token, "least")


def _set_lists(sets: DataFrame) -> DataFrame:
    """Postings (shingle, doc_id, label, n_shingles, central, left) of the prefixes of whole sets, rare shingles first.

    Two sets with a link share one of the first n - ceil(0.75 n) + 1 of their shingles. ``left`` is how many shingles
    from this one on any other document has: the most that a pair first met here can have in common. Shingles of a
    single document come first in the order and need no posting, and a document with more than a quarter of such is out.
    """
    rows = sets.select("doc_id", F.explode("shingles").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = rows.join(shared, "shingle").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("all"), F.sum("df").alias("central"))
    own = own.join(sets.select("doc_id", "label", F.size("shingles").alias("n_shingles")), "doc_id")
    # Entries of the prefix that are shared: its length less the shingles of this document alone.
    entries = F.size("all") - F.expr(f"(n_shingles * {PERCENT} + 99) div 100") + 1
    own = own.withColumn("entries", entries.cast("int")).filter("entries > 0")
    posted = own.select("doc_id", "label", "n_shingles", "central", F.size("all").alias("shared"), F.posexplode(F.slice("all", F.lit(1), F.col("entries"))).alias("at", "e"))
    return posted.select(F.col("e.shingle").alias("shingle"), "doc_id", "label", "n_shingles", "central", (F.col("shared") - F.col("at")).alias("left"))


def _meet(key, group: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) between a list's two blocks (side 0 and 1), or within one block (side 0 alone), across components: a
    forest of them. Shingles that all documents of a side have are counted once for all."""
    own = group["side"].to_numpy() == 0
    same = bool(own.all())
    doc, label, n = (group[c].to_numpy(np.int64) for c in ("doc_id", "label", "n_shingles"))
    token = np.unique(np.concatenate(group["shingles"].to_list()), return_inverse=True)[1]
    sets = np.split(token, np.cumsum(n)[:-1])
    left, right = np.flatnonzero(own), np.flatnonzero(own if same else ~own)
    # Posting lists of the right side: places in ``right`` in order of their shingles.
    flat, place = np.concatenate([sets[r] for r in right]), np.repeat(np.arange(len(right)), n[right])
    order = np.argsort(flat, kind="stable")
    flat, place = flat[order], place[order]
    start = np.searchsorted(flat, np.arange(int(token.max()) + 2))
    size = np.diff(start)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for at, a in enumerate(left):
        mine = sets[a]
        everywhere = size[mine] == len(right)
        lists = [place[start[t] : start[t + 1]] for t in mine[~everywhere].tolist()]
        common = int(everywhere.sum()) + (np.bincount(np.concatenate(lists), minlength=len(right)) if lists else np.zeros(len(right), np.int64))
        linked = (100 * common >= PERCENT * (n[a] + n[right] - common)) & (label[right] != label[a])
        if same:
            linked[: at + 1] = False
        for b in right[linked]:
            x, y = find(int(label[a])), find(int(label[b]))
            if x != y:
                root[x] = y
                out.append((doc[a], doc[b]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def near_groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have the empty set and are linked with nothing. Rows that repeat an id are one document
    and share a component; where their texts differ, links are those of the text with the smallest hash, and n_shingles
    is each row's own. Null ids have component null and stay. Equal texts tie into one class, whose smallest id stays.
    An empty table gives no rows, other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = scratch.table(rows.mapInPandas(_sign, "doc_id long, n_shingles long, key long, key2 long, sig array<long>"), "signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch.table(full.groupBy("key", "key2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    chosen = classes.groupBy("rep").agg(F.min(F.struct("key", "key2")).alias("k")).select(F.col("rep").alias("doc_id"), "k.key", "k.key2")
    reps = scratch.table(full.join(chosen, ["doc_id", "key", "key2"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "sig"), "representatives")

    # Posting lists, the rarest first; values of a single document have none.
    entries = reps.select("doc_id", "n_shingles", F.explode("sig").alias("token"))
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    listed = entries.join(shared, "token").groupBy("doc_id", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"), F.sum("df").alias("central"))
    listed = listed.filter(F.size("all") >= MATCHES)
    prefix = F.slice("all", 1, F.size("all") - (MATCHES - 1))
    posted = listed.select("doc_id", "n_shingles", "central", F.explode(prefix).alias("e")).select("doc_id", "n_shingles", "central", F.col("e.token").alias("token"))
    posted = scratch.table(posted, "postings")

    # Signatures and whole sets of the documents that any list brings together.
    wanted = scratch.table(posted.select("doc_id").distinct(), "wanted")
    sets = rows.join(wanted, "doc_id", "left_semi").mapInPandas(_sets, "doc_id long, shingles array<long>")
    # The set of a repeated id is the one that its signature is of, by size and then by order.
    sets = reps.select("doc_id", "sig", "n_shingles").join(sets, "doc_id").filter(F.size("shingles") == F.col("n_shingles"))
    sets = scratch.table(sets.dropDuplicates(["doc_id"]).select("doc_id", "sig", "shingles"), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b), those with enough collisions and then enough common shingles."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        s = sets.select("doc_id", "sig")
        close = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
        close = scratch.table(close.filter(F.size(F.array_intersect("sa", "sb")) >= MATCHES).select("a", "b"), f"{name}-close")
        t = sets.select("doc_id", "shingles")
        both = close.join(t.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa")), "a").join(t.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb")), "b")
        common = F.size(F.array_intersect("xa", "xb"))
        linked = both.filter(100 * common >= PERCENT * (F.size("xa") + F.size("xb") - common))
        return scratch.table(linked.select("a", "b"), f"{name}-links")

    def labelled(lists: DataFrame, links: DataFrame, name: str) -> DataFrame:
        found = components(links, scratch, name)
        return lists.drop("label").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")

    def centred(lists: DataFrame, token: str) -> DataFrame:
        """Pairs of each list's most central document with those of other components."""
        best = F.max(F.struct("central", (-F.col("doc_id")).alias("minus"), "label")).alias("c")
        centre = lists.groupBy(token).agg(best).select(token, (-F.col("c.minus")).alias("a"), F.col("c.label").alias("la"))
        return lists.join(centre, token).filter("label <> la").select("a", F.col("doc_id").alias("b"))

    # Each list is compared with its centre; what that links needs no further pairs.
    links = confirmed(centred(posted.withColumn("label", F.col("doc_id")), "token"), "centre")
    lists = scratch.table(labelled(posted, links, "centre"), "labels")

    # Documents of lists that still have several components meet again under the rare shingles of their whole sets.
    open_ = lists.join(_unequal(lists, "token"), "token", "left_semi").select("doc_id", "label").distinct()
    rest = scratch.table(_set_lists(sets.select("doc_id", "shingles").join(open_, "doc_id")), "open")

    def met(rest: DataFrame) -> DataFrame:
        """Postings that can meet a document of another component and have enough in common with it."""
        fits = f"left * {100 + PERCENT} >= {PERCENT} * (n_shingles + greatest(least, (n_shingles * {PERCENT} + 99) div 100))"
        rest = rest.join(_unequal(rest, "shingle"), "shingle").filter(fits).drop("least")
        return rest.join(_unequal(rest, "shingle").drop("least"), "shingle", "left_semi")

    rest = scratch.table(met(rest), "open-fit")
    more = confirmed(centred(rest, "shingle"), "open-centre")
    links = scratch.table(links.unionAll(more), "links")
    rest = scratch.table(met(labelled(rest, links, "open-centre")), "last")
    # What is left is compared across components: short lists by pairs that size and place in both sets allow.
    sizes = scratch.table(rest.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")), "sizes")
    rest = scratch.table(joined_by_share(rest, sizes, ["shingle"], "m"), "sized")
    few = rest.filter(F.col("m") <= FEW)
    one = few.select("shingle", F.col("doc_id").alias("a"), F.col("label").alias("la"), F.col("n_shingles").alias("na"), F.col("left").alias("xa"))
    two = few.select("shingle", F.col("doc_id").alias("b"), F.col("label").alias("lb"), F.col("n_shingles").alias("nb"), F.col("left").alias("xb"))
    fits = f"a < b and la <> lb and least(xa, xb) * {100 + PERCENT} >= {PERCENT} * (na + nb) and 100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"
    links = links.unionAll(confirmed(one.join(two, "shingle").filter(fits).select("a", "b"), "cross"))
    # Longer ones by blocks of about BLOCK documents: each goes where its block meets another, or itself.
    blocks = F.ceil(F.col("m") / BLOCK)
    many = rest.filter(F.col("m") > FEW).withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks)).join(sets.select("doc_id", "shingles"), "doc_id")
    many = many.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    many = many.select("shingle", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), (F.col("block") > F.col("k")).cast("int").alias("side"), "doc_id", "label", F.size("shingles").cast("long").alias("n_shingles"), "shingles")
    links = links.unionAll(scratch.table(many.groupBy("shingle", "i", "j").applyInPandas(_meet, "a long, b long"), "met"))
    found = components(links, scratch, "all").select(F.col("node").alias("rep"), "component")

    # A class of very many copies goes to all tasks, as fewer than HOT classes can have that share of the rows.
    named = classes.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    keys = ["key", "key2", "n_shingles"]
    least = max(1, signed.count() // HOT)
    hot = named.filter(F.col("copies") > least).select(*keys, F.col("component").alias("c1"))
    cold = named.filter((F.col("copies") > 1) & (F.col("copies") <= least)).select(*keys, F.col("component").alias("c2"))
    single = found.select(F.col("rep").alias("doc_id"), F.col("component").alias("c3"))
    ids = signed.select("doc_id", *keys).join(F.broadcast(hot), keys, "left")
    done, todo = ids.filter("c1 is not null"), ids.filter("c1 is null").drop("c1")
    todo = todo.join(cold, keys, "left").join(single, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c2", "c3").alias("component"))
    out = done.select("doc_id", "n_shingles", F.col("c1").alias("component")).unionAll(todo)
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return scratch.last(out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id; columns as they are."""
    gone = near_groups(docs, Scratch(spark, "near")).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
