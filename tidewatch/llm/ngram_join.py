"""N-gram Jaccard join: a grouped prefix join of documents by their sets of word shingles, and its components.

Shingles of ``k`` consecutive words, A-Z in lower case, are ordered by rarity. Documents with equal sets are collapsed; sets with
equal prefix and size form one group, which takes part in the join once. Group pairs that share a prefix token and
pass the length filter are expanded to their members and verified on the whole sets.

The result is the components of the links. Since links inside a component change nothing, the members of a token's list are
first verified against the list's first member, then against its first few and a few others; then every pair that shares
a token and still lies in different components is verified, without any bound, if the parity bitmaps of its sets allow it.

Null and blank texts have empty sets and link with nothing. Texts with fewer words than a shingle have their whole word
sequence as the only shingle. Rows that repeat an id are one document with all their links. Rows with a null id link
with nothing and have a null component. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import setjoin
from tidewatch.llm.common import counted, documents, key_filter, mix64, unused
from tidewatch.llm.words import BASE, Words
from tidewatch.session import settle

SHINGLE = 5
RARITY_BITS = 20
FEW = 12  # members of a list that the others meet in the second step


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, int]:
    """Document and hash of every shingle, repeated ones included."""
    words = Words(texts, lower=True)
    h = words.hashes()
    count, n = words.counts(), len(texts)
    of = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(n), of)
    start = words.first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(of) - of, of)
    length = np.minimum(count, k)[owner]
    out = np.zeros(len(owner), np.uint64)
    for j in range(k):
        there = length > j
        out[there] = out[there] * np.uint64(BASE) + h[start[there] + j]
    return owner, mix64(out + length.astype(np.uint64)), n


def links_and_profiles(docs: DataFrame, k: int = SHINGLE, percent: int = setjoin.PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every row, and (node, component) of the nodes with links.

    A node is the smallest id of the documents with one set.
    """
    own = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("thash"), "text")

    def tokens(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
        return shingles(b.column(2), k)

    rarity = counted(own, lambda b: tokens(b)[1], RARITY_BITS)
    every = settle(setjoin.profiles(own, tokens, rarity, "doc_id long, thash long", lambda b: [b.column(0), b.column(1)], percent), "ngram-profiles")

    known = every.where("doc_id is not null and n > 0")
    sets = settle(known.groupBy("one", "two").agg(F.min(F.struct("doc_id", "thash")).alias("first"), F.min("n").alias("n"), F.min("gid").alias("gid"), F.first("bitmap").alias("bitmap")).select("one", "two", "n", "gid", "bitmap", F.col("first.doc_id").alias("node"), F.col("first.thash").alias("thash")), "ngram-sets")
    placed = settle(every.select("doc_id", "n", "one", "two").join(sets.select("one", "two", "node"), ["one", "two"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")), "ngram-placed")

    # Groups and their lists: one row for each token that two groups or more share.
    groups = sets.select("gid", "node", "n").distinct()
    stars = groups.groupBy("gid", "n").agg(F.min("node").alias("star"))
    size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    postings = stars.agg(F.sum(size)).first()[0] or 0
    lists = setjoin.shared_lists(own.where("doc_id is not null"), tokens, rarity, postings, percent)
    lists = settle(lists.join(stars.select("gid", "star"), "gid"), "ngram-lists")

    crowded = groups.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1").select("gid")

    def possible(pairs: DataFrame) -> DataFrame:
        """The pairs that the bitmaps of their sets allow."""
        x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("y"))
        return pairs.join(x, "a").join(y, "b").where(setjoin.bitmaps_allow("na", "nb", "x", "y", percent)).select("a", "b").distinct()

    def check(pairs: DataFrame) -> DataFrame:
        """The pairs whose texts are similar; only texts of sets in pairs are shuffled, as far as a bit set tells."""
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        asked = settle(sets.join(asked, "node", "left_semi").select("node", "thash").distinct(), "ngram-asked")
        may = key_filter(asked, "thash")
        texts = own.where(may(F.col("thash"))).withColumnRenamed("doc_id", "node").join(asked, ["node", "thash"], "left_semi")
        return setjoin.verified(pairs, settle(texts.select("node", "text"), "ngram-texts"), lambda x: shingles(x, k), percent)

    def expand(pairs: DataFrame) -> DataFrame:
        """Members of the first group against the star of the second."""
        return pairs.join(groups.select("gid", F.col("node").alias("a")), "gid").select("a", F.col("star").alias("b")).where("a <> b")

    def against(first: DataFrame) -> DataFrame:
        met = lists.join(first.select("token", F.col("gid").alias("other"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("star").alias("other_star")), "token")
        return expand(met.where(F.col("gid") != F.col("other")).where(setjoin.large_enough("n", "m", percent)).where(setjoin.first_shared("n", "m", "place", "spot", percent)).select("gid", F.col("other_star").alias("star")).distinct())

    inside = groups.join(crowded, "gid").join(groups.groupBy("gid").agg(F.min("node").alias("b")), "gid").select(F.col("node").alias("a"), "b").where("a <> b")
    # rows that repeat an id are one document
    placed_sets = known.join(sets.select("one", "two", "node"), ["one", "two"]).select("doc_id", "node")
    several = settle(placed_sets.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").select("doc_id", "b"), "ngram-several")
    same = several.select(F.col("b").alias("a"), "b").limit(0)
    if several.limit(1).count():  # every text of the id is linked to the one with the least node
        same = placed_sets.join(several, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    first = lists.groupBy("token").agg(F.min(F.struct("star", "gid", "n", "place")).alias("s")).select("token", "s.*")
    tried = settle(against(first).unionByName(inside).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "ngram-pairs")
    tried = settle(possible(tried), "ngram-possible")
    links = check(tried).unionByName(same)
    found = settle(setjoin.components(links), "ngram-components")

    def with_component(nodes: DataFrame) -> DataFrame:
        return nodes.join(found.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))

    def still_open(rows: DataFrame) -> DataFrame:
        """Lists, by member, that hold two components; links only join components, so no other list opens again."""
        two = rows.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("token")
        return settle(rows.join(two, "token"), "ngram-open")

    def all_lists() -> DataFrame:
        """Every list by member; a crowded group is a list of its own."""
        members = with_component(groups)
        own_group = members.join(crowded, "gid").select(F.col("gid").alias("token"), "node", "n", F.lit(0).alias("place"), "c")
        return lists.select("token", "gid", "place").join(members, "gid").select("token", "node", "n", "place", "c").unionByName(own_group)

    def across(rows: DataFrame, others: DataFrame) -> DataFrame:
        met = rows.join(others.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("c").alias("d")), "token").where("c <> d")
        met = met.where(setjoin.large_enough("n", "m", percent)).where(setjoin.first_shared("n", "m", "place", "spot", percent))
        return met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()

    rest = None
    for order in (["node"], [F.xxhash64("node")], None):
        rest = still_open(all_lists() if rest is None else with_component(rest.drop("c")))
        pairs = across(rest, setjoin.stars(rest, order, FEW) if order else rest.where("1 = 1"))
        pairs = settle(possible(pairs.join(tried, ["a", "b"], "left_anti")), "ngram-pairs")
        if pairs.limit(1).count():
            links = links.unionByName(check(pairs))
            tried = tried.unionByName(pairs)
            found = settle(setjoin.components(links), "ngram-components")
    return placed, found


def join_components(docs: DataFrame, k: int = SHINGLE, percent: int = setjoin.PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id that each document reaches by links, itself included."""
    placed, found = links_and_profiles(docs, k, percent, id_col, text_col)
    return placed.join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = setjoin.PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id; of rows that repeat the id, one.

    Documents without words and rows with a null id all stay. Columns do not change.
    """
    placed, found = links_and_profiles(docs, k, percent, id_col, text_col)
    i, number, maybe = unused(docs, "id", "first", "may")
    gone = placed.where("n > 0").join(found, "node", "left").where("doc_id <> coalesce(component, node)").select(F.col("doc_id").alias(i)).distinct()
    gone = settle(gone, "ngram-gone")
    repeated = settle(placed.where("n > 0").groupBy(F.col("doc_id").alias(i)).agg(F.count("*").alias("m")).where("m > 1").select(i), "ngram-repeated").join(gone, i, "left_anti")
    may = key_filter(gone.union(repeated), i)
    marked = docs.withColumn(maybe, F.coalesce(may(F.col(id_col).cast("long")), F.lit(False)))
    alone, rest = marked.where(~F.col(maybe)).drop(maybe), marked.where(F.col(maybe)).drop(maybe)
    own = F.col(id_col).cast("long") == F.col(i)
    kept = rest.join(gone, own, "left_anti")
    blank = ~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    twice = kept.join(repeated, own, "left_semi")
    one = twice.where(~blank).withColumn(number, F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)))).where(F.col(number) == 1).drop(number)
    return alone.unionByName(kept.join(repeated, own, "left_anti")).unionByName(twice.where(blank)).unionByName(one)
