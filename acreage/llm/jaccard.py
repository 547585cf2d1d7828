"""Operator 3: exact n-gram Jaccard join by prefix tokens and components.

A document's set are its distinct word shingles (64-bit hashes).  Equal sets form one
class, so copies cost nothing further.

1. Tokens get one global order, rare ones first: by the log of their number of
   documents, then by hash.  The numbers come from fixed-size count sketches of all
   documents; the order need not be exact, only the same everywhere.
2. Two sets of similarity t share one of the first n - ceil(t n) + 1 tokens of each
   (the prefix).  Prefix tokens of one class alone are dropped.
3. Classes are partitioned into groups of similar ones: by the least hash of their
   shared prefix tokens, under several hash functions.  Each group's leader is the class
   with the smallest share of tokens of its own; every member is compared with it, and
   linked members become components.
4. A token whose postings all lie in a single component needs no further work.  The classes
   of the other postings are partitioned anew, by the least hash of these tokens and by
   size, and a token-group matrix holds the union of each group's tokens with the bounds
   of its members.  Every class is a query: the tokens that it shares with a group's union
   are counted, and the group is opened only where the count can reach the overlap that a
   member of a fitting size needs.  In opened groups the same bound is taken for each pair,
   and pairs within it are compared exactly.

A group's bound holds for each of its members, so no
link between components is missed and the components are exact; pairs inside a component
need no comparison.  All steps are joins and sums over tokens, groups or pairs.

Defined results: null texts and texts without words have empty sets, linked with
nothing; a text of fewer words than a shingle is one shingle; equal rows fall into one
class; a null key is kept (its component is the least key of it, null if alone); an
empty table gives no rows; very long texts are hashed segment by segment, whole; other
columns pass through ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import bitmap, discard, in_bitmap, list_array, mix, shingle_hashes, small_batches, stored, text_bytes, word_hashes
from acreage.llm.components import components

WORD = np.ones(256, dtype=bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
SLOTS = 22                # log2 of the slots of the count sketch
LOCAL = 4                 # a task reports the slots that it counted so often
SEEDS = tuple(np.uint64(x) for x in (0, 0x632BE59BD9B4E019, 0xD1B54A32D192ED03, 0x94D049BB133111EB))
MEMBERS_LOG2 = 27


def token_set(text, shingle: int) -> np.ndarray:
    words, _, _ = word_hashes(text, WORD)
    return np.unique(shingle_hashes(words, shingle))


def set_id(tokens: np.ndarray) -> int:
    """64-bit identity of a sorted set."""
    if not len(tokens):
        return 0
    place = mix(np.arange(1, len(tokens) + 1, dtype=np.uint64))
    return int(mix(np.array([np.bitwise_xor.reduce(mix(tokens ^ place)) + np.uint64(len(tokens))], dtype=np.uint64)).view(np.int64)[0])


def frequency(docs: DataFrame, shingle: int, text: str) -> np.ndarray:
    """log2 of the number of documents by slot of the token's hash (at most 2^SLOTS rows reach the driver)."""

    def count(batches):
        slots = np.zeros(1 << SLOTS, dtype=np.int32)
        for batch in batches:
            for t in text_bytes(batch.column(0)):
                at = (token_set(t, shingle) >> np.uint64(64 - SLOTS)).astype(np.int64)
                np.add.at(slots, at, 1)
        found = np.flatnonzero(slots >= LOCAL)
        for a in range(0, len(found), 100_000):
            part = found[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(slots[part], pa.int64())], names=["slot", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOTS, dtype=np.uint8)
    out[rows.column("slot").to_numpy()] = np.log2(rows.column("n").to_numpy()).astype(np.uint8)
    return out


def prefixes(docs: DataFrame, shared, shingle: int, num: int, den: int, text: str, key: str) -> DataFrame:
    """(doc_id, text_id, n, set_id, prefix) of every document; the prefix in the global order."""
    kind = dict(docs.dtypes)[key]

    def cut(batches):
        level = shared.value
        for batch in batches:
            n, ids, parts = [], [], []
            for t in text_bytes(batch.column(1)):
                s = token_set(t, shingle)
                n.append(len(s))
                ids.append(set_id(s) if len(s) else None)
                order = np.argsort(level[(s >> np.uint64(64 - SLOTS)).astype(np.int64)], kind="stable")   # s is sorted by hash
                parts.append(s[order[:len(s) - -(-num * len(s) // den) + 1]] if len(s) else s)
            flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), list_array(flat, [len(p) for p in parts], pa.int64())],
                                             names=["doc_id", "text_id", "n", "set_id", "prefix"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), text_id(key, text).alias("text_id")).mapInArrow(
        cut, f"doc_id {kind}, text_id bigint, n bigint, set_id bigint, prefix array<bigint>")


def text_id(key: str, text: str):
    """Identity of a row's key and text."""
    return F.xxhash64(F.col(key), F.col(text))


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, text: str, key: str) -> DataFrame:
    """(set_id, tokens) of wanted classes, from the rows named by text_id.  A fixed-size bitmap drops
    other rows before their sets are made; the few that pass it by chance meet no pair later."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("text_id").alias("h")), "h", MEMBERS_LOG2))

    def find(batches):
        table = bits.value
        for batch in batches:
            use = in_bitmap(table, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            found = [token_set(t, shingle) for t, u in zip(text_bytes(batch.column(0)), use) if u]
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in found], pa.int64()), list_array(flat, [len(x) for x in found], pa.int64())],
                                             names=["set_id", "tokens"])

    rows = docs.select(F.col(text).alias("text"), F.xxhash64(text_id(key, text)).alias("h"))
    return rows.mapInArrow(find, "set_id bigint, tokens array<bigint>")


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, shingle: int, num: int, den: int, text: str, key: str) -> DataFrame:
    """The pairs (a, b) of classes whose sets have the similarity.  The stored table of pairs is deleted."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(classes.select("set_id", "text_id"), "set_id")
    wanted = stored(wanted, "wanted")
    sets = stored(sets_of(docs, wanted, shingle, text, key), "sets")
    left, right = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    enough = F.size(F.array_intersect("ta", "tb")) * (num + den) >= num * (F.size("ta") + F.size("tb"))
    links = stored(both.where(enough).select("a", "b").distinct(), "links")
    discard(wanted, sets, pairs)
    return links


def short_of(shared, a, b, num: int, den: int):
    """Whether ``shared`` common prefix tokens are too few for sets of a and b tokens.  The set whose prefix ends first
    has all its common prefix tokens in the other's prefix, and fewer than num / den of its tokens after it."""
    need = num * den * (a + b) - num * (num + den) * F.greatest(a, b)
    return shared * (den * (num + den)) <= need


def candidates(posts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes of different roots that can have the similarity, from the postings (set_id, n, at, nth,
    token, root) of their prefix tokens, through a token-group matrix."""
    posts = posts.select("set_id", "n", "at", "nth", "token", "root")
    group = posts.groupBy("set_id").agg(F.struct(F.min(F.xxhash64("token")).alias("least"), F.floor(4 * F.log2(F.max("n"))).alias("size")).alias("group"))
    grouped = stored(posts.join(group, "set_id"), "grouped")
    matrix = stored(grouped.groupBy("group", "token").agg(F.max("nth").alias("nths"), F.max(F.col("n") - F.col("at")).alias("tail"), F.min("n").alias("lo"),
                                                          F.max("n").alias("hi"), F.max("root").alias("roots")), "matrix")
    # sizes of members that fit the query; the bounds below are least at one of the two ends
    lo = F.greatest(F.col("lo"), F.ceil(F.col("n") * num / den))
    hi = F.least(F.col("hi"), F.floor(F.col("n") * den / num))
    enough = lambda room, a, b: room * (num + den) >= num * (a + b)
    # of a pair's common tokens at most ``nth`` are before this one and the shorter tail from it on, so a pair within
    # the similarity passes at each of them, and its group with it
    room = F.least("nth", "nths") + F.least(F.col("n") - F.col("at"), F.col("tail"))
    met = posts.join(matrix, "token").where(F.col("root") < F.col("roots")).where(lo <= hi).where(enough(room, F.col("n"), lo))
    open_ = met.groupBy("set_id", "group", "n").agg(F.count(F.lit(1)).alias("shared"), F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    open_ = stored(open_.where(~short_of(F.col("shared"), F.col("n"), F.col("lo"), num, den) | ~short_of(F.col("shared"), F.col("n"), F.col("hi"), num, den))
                   .select("set_id", "group"), "open")
    x = posts.join(open_, "set_id").select("group", "token", F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("nth").alias("qa"), F.col("root").alias("ra"))
    y = grouped.select("group", "token", F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("nth").alias("qb"), F.col("root").alias("rb"))
    room = F.least("qa", "qb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    pairs = (x.join(y, ["group", "token"]).where("ra < rb").where(fits).where(enough(room, F.col("na"), F.col("nb")))
             .groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
             .where(~short_of(F.col("shared"), F.col("na"), F.col("nb"), num, den)).select("a", "b"))
    pairs = stored(pairs, "pairs")
    discard(grouped, matrix, open_)
    return pairs


def similar(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, text_id, n_shingles, component_id, kept (it is the component's least row, by
    doc_id, then text_id).  Similarity of at least num / den."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(frequency(docs, shingle, text))       # 2^SLOTS bytes
    every = stored(prefixes(docs, shared, shingle, num, den, text, key), "prefixes")
    some = every.where("set_id is not null")
    classes = stored(some.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("text_id").alias("text_id"), F.min("n").alias("n"),
                                                    F.min(F.struct("doc_id", "text_id")).alias("row")), "classes")
    # one row of each class (a copy that passes the bitmap by chance does no harm below)
    chosen = docs.sparkSession.sparkContext.broadcast(bitmap(classes.select(F.xxhash64("text_id").alias("h")), "h", MEMBERS_LOG2))

    def of_class(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(chosen.value, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])

    reps = some.select(F.xxhash64("text_id").alias("h"), "set_id", "n", "prefix").mapInArrow(of_class, "set_id bigint, n bigint, prefix array<bigint>")

    # prefix tokens of more than one class
    tokens = reps.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("m"))
    tokens = stored(tokens.where("m > 1").select("token"), "tokens")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(tokens, "token", MEMBERS_LOG2))

    def postings(batches):
        table = bits.value
        for batch in batches:
            column = batch.column(2)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(in_bitmap(table, flat.view(np.uint64)))
            row = np.repeat(np.arange(len(sizes)), sizes)[at]
            begin = np.cumsum(sizes) - sizes
            place, nth = at - begin[row], np.arange(len(at)) - np.searchsorted(at, begin)[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(sizes[row].astype(np.int32)),
                                              pa.array(place.astype(np.int32)), pa.array(nth.astype(np.int32)), pa.array(flat[at])],
                                             names=["set_id", "n", "size", "at", "nth", "token"])

    posts = stored(reps.mapInArrow(postings, "set_id bigint, n bigint, size int, at int, nth int, token bigint").join(tokens, "token", "left_semi"), "postings")
    rows = stored(every.select("doc_id", "text_id", "n", "set_id"), "rows")
    discard(every, tokens)

    # groups and their leaders
    member = posts.groupBy("set_id", "n", "size").agg(F.count("*").alias("c"), *[F.min(F.xxhash64("token", F.lit(int(x.view(np.int64))))).alias(f"k{i}") for i, x in enumerate(SEEDS)])
    groups = stored(member.select("set_id", "n", (F.col("c") / F.col("size")).alias("share"), F.posexplode(F.array(*[f"k{i}" for i in range(len(SEEDS))])).alias("seed", "group")), "groups")
    leaders = groups.groupBy("seed", "group").agg(F.max(F.struct("share", "set_id", "n")).alias("lead"), F.count("*").alias("members")).where("members > 1")
    fits = lambda a, b: (F.least(a, b) * den >= F.greatest(a, b) * num)
    stars = (groups.join(leaders, ["seed", "group"]).where(F.col("set_id") != F.col("lead.set_id")).where(fits(F.col("n"), F.col("lead.n")))
             .groupBy(F.greatest("set_id", "lead.set_id").alias("a"), F.least("set_id", "lead.set_id").alias("b")).agg(F.count("*").alias("seeds"))
             .where("seeds > 1").select("a", "b"))          # one seed alone is mostly chance; step 4 misses nothing
    stars = stored(stars, "stars")
    discard(groups)
    links = verify(docs, stars, classes, shingle, num, den, text, key)
    roots = components(links)

    def crossing(roots: DataFrame) -> DataFrame:
        """Postings of the tokens that stand in several components."""
        placed = posts.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        tokens = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
        return stored(placed.join(tokens, "token", "left_semi"), "crossing")

    # one row for each posting: the class of each token with the fewest tokens of its own before it links most others
    placed = crossing(roots)
    heads = placed.groupBy("token").agg(F.min(F.struct((F.col("at") - F.col("nth")).alias("own"), "set_id", "n", "root")).alias("lead"))
    near = (placed.join(heads, "token").where(F.col("root") != F.col("lead.root")).where(fits(F.col("n"), F.col("lead.n")))
            .select(F.greatest("set_id", "lead.set_id").alias("a"), F.least("set_id", "lead.set_id").alias("b")).distinct())
    second = verify(docs, stored(near, "near"), classes, shingle, num, den, text, key)
    if not second.isEmpty():
        links = stored(links.unionByName(second), "links")
        roots, before = components(links), placed
        placed = crossing(roots)
        discard(before)
    discard(posts)

    opened = candidates(placed, num, den)
    discard(placed)
    more = verify(docs, opened, classes, shingle, num, den, text, key)
    if more.isEmpty():
        final = roots
    else:
        final = components(links.unionByName(more))
    least = (classes.join(final.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
             .select("set_id", "root", "least", "row"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"), F.min("row").alias("row"))
    named = least.drop("least", "row").join(of_root, "root").select("set_id", "component_id", "row")
    kept = F.col("set_id").isNull() | (F.struct("doc_id", "text_id") == F.col("row"))
    return (rows.select("doc_id", "text_id", F.col("n").alias("n_shingles"), "set_id").join(named, "set_id", "left")
            .select("doc_id", "text_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), kept.alias("kept")))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One document of each component: the one of the least key, of equal keys that of the least hash of key and
    text, of repeated rows any.  Documents with empty sets stay."""
    found = similar(docs, text=text, key=key, **options).select("text_id", "n_shingles", "kept")
    # what happens to a row's identity: all its rows go, or one stays; identities that only stay as they are are left out
    fate = found.where("n_shingles > 0").groupBy("text_id").agg(F.max("kept").alias("one"), F.count(F.lit(1)).alias("rows")).where("not one or rows > 1")
    fate = stored(fate.select("text_id", "one"), "fate")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(fate.select(F.xxhash64("text_id").alias("h")), "h", MEMBERS_LOG2))

    @F.pandas_udf("boolean")
    def touched(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bits.value, h.to_numpy().view(np.uint64)))

    # only the few texts that the bitmap lets through (all that can go, and some by chance) are shuffled
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_id(key, text).alias("text_id"))
    rows = rows.withColumn("touched", touched(F.xxhash64("text_id")))
    some = rows.where("touched").join(fate, "text_id", "left")
    one = some.where("one").groupBy("text_id").agg(F.first("row").alias("row"))
    return rows.where("not touched").select("row").unionByName(some.where("one is null").select("row")).unionByName(one.select("row")).select("row.*")
