"""Ranked lexical search over a clustered index whose documents stand in the order of a recursive graph bisection.

Documents and terms are a bipartite graph. It is bisected again and again: documents trade sides while that lowers the
logarithmic cost of the gaps between a term's postings. The bisection is fitted on a sample of at most ``SAMPLE`` documents, whose terms are dealt to
``CELLS`` cells; each split becomes a weight of every cell and a threshold, and all documents go down this tree. A
document's new place is its leaf and its number there. The leaves, or even parts of those that hold too many postings, are the index's
shards: of each term its postings with their impacts, and the largest impact, which bounds what the term can give.

A query visits shards by the sum of its terms' bounds, in rounds that quadruple. It ends, exactly, when no shard is
left whose bound reaches the score of its last place; a bound equal to it is visited too, as its documents may have
smaller ids. Places are mapped back to ids inside the shard, before ties are decided. The tree and the sample change how many shards are visited, never a result.

Scores are integers. A term's weight w is floor(1000 * ln((2N + 2) / (2 df + 1))), its impact in a document
(10^9 tf) div (1000 tf + 8m), with m = 10 + (90 n N) div L; N counts documents with a term, L all terms, n those of the
document, df documents with the term, tf its occurrences.

Defined results: null and empty texts hold no terms: such documents are never found, such queries find nothing. Rows of equal id are documents and
queries of their own; documents without an id come last among equal scores. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .graphs import filter_bits, hash_bits, held_in
from .store import discard, materialize, small_batches, tidied

#: Documents that the bisection is fitted on at most, those of least hash, and cells of their terms.
SAMPLE, CELLS = 1 << 13, 1 << 12
#: Splits below each other at most; sample documents of a leaf at least; rounds of trading in a split.
DEPTH, LEAF, TRADES = 8, 16, 8
#: Postings of a shard on average at most, and queries that visit it in one group.
POSTINGS, QUERIES = 1 << 16, 256
#: Shards that each query visits in the first round; every further round goes up to four times as many.
FIRST = 4


def _terms(batch: pa.RecordBatch, bits: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """For every block: rows [i, j), all their terms' numbers, and of each row the distinct wanted terms and occurrences."""
    data, offsets = K.utf8_rows(batch.column(1))
    for i, j in K.blocks(offsets):
        w = K.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], K.ALNUM)
        terms, counts = [], []
        for a, b in zip(w.first[:-1], w.first[1:]):
            own = w.hashes[a:b]
            own, n = np.unique(own if bits is None else own[held_in(bits, own)], return_counts=True)
            terms.append(own.view(np.int64))
            counts.append(n.astype(np.int32))
        yield i, j, np.diff(w.first), terms, counts


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def _forward(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, sizes, terms, counts in _terms(batch, bits):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes.astype(np.int64)), _lists(terms), _lists(counts)], names=["id", "n", "terms", "counts"])


def cells_of(terms: np.ndarray) -> np.ndarray:
    return (terms.view(K.U64) >> K.U64(64 - (CELLS.bit_length() - 1))).astype(np.int64)


def _cost(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of the gaps of a cell's ``degree`` postings in a part of ``size`` documents."""
    return degree * (np.log2(np.maximum(size, 1))[:, None] - np.log2(degree + 1.0))


class Bisection:
    """Splits, by level and node: a weight for every cell, and the threshold above which a document goes to the right."""

    def __init__(self, weights: list[np.ndarray], thresholds: list[np.ndarray]):
        self.weights, self.thresholds = weights, thresholds

    @property
    def leaves(self) -> int:
        return 1 << len(self.weights)

    @staticmethod
    def fit(documents: list[np.ndarray], depth: int = DEPTH) -> Bisection:
        """Bisect documents, each a list of distinct cells, ``depth`` times or until the parts are small."""
        n = len(documents)
        of = np.repeat(np.arange(n), [len(d) for d in documents])
        cell = np.concatenate([np.asarray(d, np.int64) for d in documents]) if n else np.zeros(0, np.int64)
        part, weights, thresholds = np.zeros(n, np.int64), [], []
        for level in range(depth):
            parts = 1 << level
            if n < 2 * LEAF * parts:
                break
            rank = _rank(part, np.arange(n))
            right = rank >= (np.bincount(part, minlength=parts)[part] + 1) // 2
            for _ in range(TRADES):
                go, come, _ = _gains(part, right, of, cell, parts)
                gain = np.bincount(of, np.where(right[of], come[part[of], cell], go[part[of], cell]), n)
                # the documents that gain most on each side trade places, one for one, while both together gain
                place = _rank(2 * part + right, -gain)
                swaps = _swaps(part, right, place, gain, parts)
                if not swaps.any():
                    break
                right = right ^ swaps
            _, _, weight = _gains(part, right, of, cell, parts)
            score = np.bincount(of, weight[part[of], cell], n)
            # halves of the sample
            order = np.lexsort((score, part))
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            middle = np.array([score[order[(a + b) // 2 - 1 : (a + b) // 2 + 1]].mean() if b - a > 1 else 0.0 for a, b in zip(ends[:-1], ends[1:])])
            weights.append(weight.astype(np.float32))
            thresholds.append(middle.astype(np.float32))
            part = 2 * part + (np.bincount(of, weights[-1][part[of], cell].astype(np.float64), n) > thresholds[-1][part])
        return Bisection(weights, thresholds)

    def leaf(self, documents: list[np.ndarray]) -> np.ndarray:
        """The leaf of each document, from left to right."""
        n = len(documents)
        of, cell = np.repeat(np.arange(n), [len(d) for d in documents]), np.concatenate(documents)
        part = np.zeros(n, np.int64)
        for weight, threshold in zip(self.weights, self.thresholds):
            part = 2 * part + (np.bincount(of, weight[part[of], cell].astype(np.float64), n) > threshold[part])
        return part


def _rank(group: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each one's number inside its group, in the order of ``by``."""
    order = np.lexsort((by, group))
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - np.searchsorted(group[order], group[order])
    return out


def _swaps(part: np.ndarray, right: np.ndarray, place: np.ndarray, gain: np.ndarray, parts: int) -> np.ndarray:
    """Which documents change sides: those whose partner of the same place on the other side gains with them."""
    most = int(place.max()) + 1 if len(place) else 1
    best = np.full((2, parts * most), -np.inf)
    key = part * most + place
    best[right.astype(np.int64), key] = gain
    return (best[0] + best[1] > 1e-9)[key]


def _gains(part: np.ndarray, right: np.ndarray, of: np.ndarray, cell: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By part and cell: bits gained by one that goes right, by one that comes left, and the cost of left less that of right."""
    sides = []
    for side in (~right, right):
        held = side[of]
        sides.append((np.bincount(part[of[held]] * CELLS + cell[held], minlength=parts * CELLS).reshape(parts, CELLS), np.bincount(part[side], minlength=parts)))
    (dl, nl), (dr, nr) = sides
    cost = lambda l, r: _cost(np.maximum(l, 0), nl) + _cost(np.maximum(r, 0), nr)
    now = cost(dl, dr)
    return now - cost(dl - 1, dr + 1), now - cost(dl + 1, dr - 1), _cost(dl + 1, nl) - _cost(dl, nl) - _cost(dr + 1, nr) + _cost(dr, nr)


_ROUTED = "row long, id long, n long, terms array<long>, counts array<int>, leaf int"


def _route(batches: Iterator[pa.RecordBatch], tree: Bisection) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))[:-1]
        leaf = tree.leaf([np.unique(cells_of(t)) for t in np.split(flat, ends)]) if batch.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], names=[f.split()[0] for f in _ROUTED.split(", ")])


_SHARDS = "shard int, term long, df int, most int, at binary, impacts binary, ids array<long>"


def _shard(group: pa.Table, n_docs: int, n_terms: int) -> pa.Table:
    """One shard: a row with its documents' ids in their new order, and a row of postings for each term."""
    group = group.sort_by([("row", "ascending")]).combine_chunks()
    sizes = group["n"].to_numpy()
    m = 10 + (90 * sizes * n_docs) // n_terms
    lengths = group["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(group.num_rows, dtype=np.int32), lengths)
    terms, counts = (group[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
    impacts = ((1_000_000_000 * counts) // (1000 * counts + 8 * m[at])).astype(np.int32)
    order = np.lexsort((at, terms))
    terms, at, impacts = terms[order], at[order], impacts[order]
    begin = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    end = np.append(begin[1:], len(terms))
    k = len(begin)
    blobs = [[x[a:b].tobytes() for a, b in zip(begin, end)] for x in (at, impacts)]
    return pa.table(
        [
            pa.array(np.full(k + 1, group["shard"][0].as_py(), np.int32)),
            pa.array([None, *terms[begin].tolist()], pa.int64()),
            pa.array([None, *(end - begin).tolist()], pa.int32()),
            pa.array([None, *np.maximum.reduceat(impacts, begin).tolist()], pa.int32()),
            pa.array([None, *blobs[0]], pa.binary()),
            pa.array([None, *blobs[1]], pa.binary()),
            pa.array([group["id"].to_pylist(), *[None] * k], pa.list_(pa.int64())),
        ],
        names=[f.split()[0] for f in _SHARDS.split(", ")],
    )


class ClusteredIndex:
    """Shards of postings in the shared folder. ``terms``: a bit set of the terms to index (``hash_bits``), all if None."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", terms: np.ndarray | None = None):
        spark = self.spark = docs.sparkSession
        small_batches(spark)
        held = spark.sparkContext.broadcast(terms.tobytes()) if terms is not None else None
        rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        wanted = lambda: np.frombuffer(held.value, np.uint64) if held else None
        scanned = rows.mapInArrow(lambda b: tidied(_forward(b, wanted())), "id long, n long, terms array<long>, counts array<int>")
        forward, path = materialize(scanned.where("n > 0").select(F.monotonically_increasing_id().alias("row"), "*"), "forward")
        self.n_docs, self.n_terms, postings = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        some = forward.where(F.size("terms") > 0)
        # a sample of bounded size: rows by their number, and of each no more than CELLS cells
        cell = F.array_sort(F.array_distinct(F.transform("terms", lambda t: F.shiftrightunsigned(t, 64 - (CELLS.bit_length() - 1)).cast("int"))))
        order = F.pmod(F.xxhash64("row"), F.lit(1 << 40))
        few = order < int((1 << 40) * min(1.0, 2 * SAMPLE / max(1, self.n_docs)))  # about twice the sample, however many tasks
        sample = some.select(order.alias("order"), "row", cell.alias("cells")).where(few).orderBy("order", "row").limit(SAMPLE).toArrow()["cells"]
        self.tree = Bisection.fit([np.asarray(c.values) for c in sample], min(DEPTH, (-(-postings // POSTINGS) - 1).bit_length()))
        tree = spark.sparkContext.broadcast(self.tree)  # at most 2^DEPTH * CELLS weights
        routed, routed_path = materialize(some.mapInArrow(lambda b: tidied(_route(b, tree.value)), _ROUTED), "routed")
        sizes = dict(routed.groupBy("leaf").agg(F.sum(F.size("terms"))).collect())  # a row for each leaf
        splits = [max(1, -(-sizes.get(leaf, 0) // POSTINGS)) for leaf in range(self.tree.leaves)]
        firsts = np.concatenate([[0], np.cumsum(splits)[:-1]]).tolist()
        split, first = (F.get(F.array(*map(F.lit, x)), F.col("leaf")) for x in (splits, firsts))
        dealt = routed.withColumn("shard", (first + F.pmod(F.xxhash64("row"), split)).cast("int")).drop("leaf")
        n_docs, n_terms = self.n_docs, self.n_terms
        self.shards, self.path = materialize(dealt.groupBy("shard").applyInArrow(lambda g: _shard(g, n_docs, n_terms), _SHARDS), "index")
        discard(spark, path, routed_path)
        if held:
            held.unpersist()
        tree.unpersist()

    def weighted(self, queries: DataFrame) -> DataFrame:
        """``query, term, weight`` of queries' terms (query, term) that the index holds."""
        df = self.shards.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.ln(F.lit(2.0 * self.n_docs + 2) / (2 * F.col("df") + 1)))
        return queries.join(df, "term").select("query", "term", weight.cast("long").alias("weight")).where("weight > 0")

    def search(self, queries: DataFrame, k: int = 10) -> tuple[DataFrame, int]:
        """``query, place, id, score``: the ``k`` best documents of each query (query, term: distinct rows), and shards visited.

        Only documents with a score above 0; equal scores by ascending id.
        """
        spark = self.spark
        asked, asked_path = materialize(self.weighted(queries), "weighted")
        bounds = self.shards.where("term IS NOT NULL").select("shard", "term", "most").join(asked, "term").groupBy("query", "shard").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))
        by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "shard")
        bounds, bounds_path = materialize(bounds.withColumn("turn", F.row_number().over(by_bound)), "bounds")
        blocks = max(1, -(-asked.select("query").distinct().count() // QUERIES))
        tops, tops_path, done, upto, visited = None, None, 0, FIRST, 0
        while True:
            turn = bounds.where((F.col("turn") > done) & (F.col("turn") <= upto))
            if tops is not None:
                turn = self._worth(turn, tops, k)
            turn, turn_path = materialize(turn.select("query", "shard", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")), "turn")
            visited += turn.count()
            found = self._visit(turn, asked, k)
            if tops is not None:
                found = found.unionByName(tops)
            best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
            nxt, new = materialize(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("query", "id", "score"), "tops")
            discard(spark, turn_path, *filter(None, [tops_path]))
            tops, tops_path, done, upto = nxt, new, upto, 4 * upto
            if self._worth(bounds.where(F.col("turn") > done), tops, k).isEmpty():
                break
        discard(spark, asked_path, bounds_path)
        return tops.withColumn("place", F.row_number().over(best)), visited

    @staticmethod
    def _worth(turn: DataFrame, tops: DataFrame, k: int) -> DataFrame:
        """Visits that can still give a document among the query's best."""
        last = tops.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") >= k).select("query", "last")
        return turn.join(last, "query", "left").where(F.coalesce(F.col("bound") >= F.col("last"), F.lit(True))).drop("last")

    def _visit(self, turn: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """The best documents of every query in every shard that it visits."""
        terms = turn.join(asked, "query").select("shard", "block", "query", "term", "weight")
        postings = self.shards.where("term IS NOT NULL").join(terms.select("shard", "block", "term").distinct(), ["shard", "term"])
        places = self.shards.where("term IS NULL").join(turn.select("shard", "block").distinct(), "shard")
        columns = [F.col("shard").alias("of_shard"), F.col("block").alias("of_block"), "term", "at", "impacts", "ids"]
        shards = postings.select(*columns).unionByName(places.select(*columns))
        return terms.groupBy("shard", "block").cogroup(shards.groupBy("of_shard", "of_block")).applyInArrow(lambda a, b: _best(a, b, k), "query long, id long, score long")


def _best(terms: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    out: list[list] = [[], [], []]
    ids, postings = [], {}
    for term, at, impacts, own in zip(*(shard[c].to_pylist() for c in ("term", "at", "impacts", "ids"))):
        if term is None:
            ids = own
        else:
            postings[term] = np.frombuffer(at, np.int32), np.frombuffer(impacts, np.int32).astype(np.int64)
    named = np.array([i is not None for i in ids], bool)
    values = np.array([i or 0 for i in ids], np.int64)
    queries, term, weight = (terms[c].to_numpy() for c in ("query", "term", "weight"))
    order = np.argsort(queries, kind="stable")
    cuts = np.flatnonzero(np.diff(queries[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        scores = np.zeros(len(ids), np.int64)
        for t, w in zip(term[own].tolist(), weight[own].tolist()):
            if t in postings:
                at, impacts = postings[t]
                scores[at] += w * impacts
        some = np.flatnonzero(scores > 0)
        if len(some) > k:
            some = some[scores[some] >= np.partition(scores[some], len(some) - k)[len(some) - k]]
        best = some[np.lexsort((values[some], ~named[some], -scores[some]))][:k]
        out[0] += [int(queries[own[0]])] * len(best)
        out[1] += [ids[b] for b in best.tolist()]
        out[2] += scores[best].tolist()
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["query", "id", "score"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, _, terms, _ in _terms(batch, None):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(terms)], names=["query", "terms"])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, through an index of the items' terms."""
    small_batches(docs.sparkSession)
    asked, asked_path = materialize(items.select(F.monotonically_increasing_id().alias("query"), F.col(item_text).alias("text"), F.col(item_key).alias("item_id")), "items")
    lists = asked.select("query", "text").mapInArrow(lambda b: tidied(_query_terms(b)), "query long, terms array<long>")
    terms, terms_path = materialize(lists.select("query", F.explode("terms").alias("term")), "terms")
    distinct = terms.select("term").distinct()
    index = ClusteredIndex(docs, key, text, hash_bits(distinct, "term", filter_bits(distinct.count())))
    found, _ = index.search(terms, k)
    discard(docs.sparkSession, index.path, terms_path)
    return found.join(asked.select("query", "item_id"), "query").select("item_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
