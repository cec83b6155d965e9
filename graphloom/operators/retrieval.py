"""Text and vector retrieval in long form: postings, scores, rankings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.skew import hot_keys, salted_join
from graphloom.session import cut

Terms = Callable[[Column], Column]


def postings(corpus: DataFrame, terms: Terms = X.terms) -> DataFrame:
    """``(scope, doc_id, term, tf, length)`` from ``corpus(scope, doc_id, text)``.

    ``length`` is the number of all terms of the document. Texts without terms
    have no postings.
    """
    rows = corpus.select("scope", "doc_id", terms(F.col("text")).alias("_t"))
    # the outer form spares a filter on the size of the terms, which would make Spark tokenise twice
    exploded = rows.select("scope", "doc_id", F.size("_t").alias("length"), F.explode_outer("_t").alias("term")).where("term is not null")
    return exploded.groupBy("scope", "doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, terms: Terms = X.terms) -> DataFrame:
    """``(scope, query_id, term, qtf)`` from ``queries(scope, query_id, text)``."""
    return queries.select("scope", "query_id", F.explode_outer(terms(F.col("text"))).alias("term")).where("term is not null").groupBy("scope", "query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _statistics(corpus: DataFrame, terms: Terms) -> DataFrame:
    """For each scope the number of documents and their mean length, empty ones included."""
    return corpus.select("scope", F.size(terms(F.col("text"))).alias("_n")).groupBy("scope").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("_n").alias("mean_length"))


def _matches(corpus: DataFrame, queries: DataFrame, terms: Terms) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of terms that some query asks for; document frequencies; the queries' terms."""
    asked = query_terms(queries, terms)
    wanted = asked.select("scope", "term").distinct()
    # the corpus shrinks to the postings asked for before anything else is joined
    # and is written, as it is counted and then scored: tokenising twice costs more
    found = cut(postings(corpus, terms).join(wanted, ["scope", "term"], "left_semi"), "postings")
    frequency = found.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
    return found, frequency, asked


def bm25(corpus: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, terms: Terms = X.terms, epsilon: float = 1e-9, swapped: bool = False) -> DataFrame:
    """Okapi BM25 within each scope: ``(scope, query_id, doc_id, score)`` of documents that share a term.

    A query counts each of its terms once. ``swapped`` takes the form
    ``tf * k1 / (tf + k1 * (b + (1 - b) * length / mean))`` that one of the
    published variants uses.
    """
    found, frequency, asked = _matches(corpus, queries, terms)
    stats = _statistics(corpus, terms)
    relative = F.col("length") / F.col("mean_length")
    if swapped:
        weight = F.col("tf") * k1 / (F.col("tf") + k1 * (b + (1 - b) * relative))
    else:
        weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * relative) + epsilon)
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    # all that a term needs goes to the queries' side, so that the postings are joined once
    asked = asked.join(frequency, ["scope", "term"]).join(stats, "scope").select("scope", "query_id", "term", idf.alias("_idf"), "mean_length")
    met = salted_join(found, asked, ["scope", "term"], "doc_id", "inner")
    return met.groupBy("scope", "query_id", "doc_id").agg(F.sum(F.col("_idf") * weight).alias("score"))


def tfidf(corpus: DataFrame, queries: DataFrame, terms: Terms = X.terms, sublinear: bool = False) -> DataFrame:
    """Cosine of TF-IDF vectors within each scope: ``(scope, query_id, doc_id, score)``.

    idf is ``ln((1 + n) / (1 + df)) + 1``; terms that no document has are
    outside the vocabulary.
    """
    every = cut(postings(corpus, terms), "postings")
    frequency = every.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
    sizes = corpus.groupBy("scope").agg(F.count(F.lit(1)).alias("n_docs"))
    idf = frequency.join(sizes, "scope").select("scope", "term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    damp = (lambda c: 1 + F.log(c)) if sublinear else (lambda c: c)
    # terms that very many documents have are spread over tasks
    hot = cut(hot_keys(every, ["scope", "term"]), "hot-terms")
    docs = salted_join(every, idf, ["scope", "term"], "doc_id", "inner", hot=hot).select("scope", "doc_id", "term", (damp(F.col("tf")) * F.col("idf")).alias("_d"))
    norms = docs.groupBy("scope", "doc_id").agg(F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("_dn"))
    asked = query_terms(queries, terms).join(idf, ["scope", "term"]).select("scope", "query_id", "term", (damp(F.col("qtf")) * F.col("idf")).alias("_q"))
    qnorms = asked.groupBy("scope", "query_id").agg(F.sqrt(F.sum(F.col("_q") * F.col("_q"))).alias("_qn"))
    dots = salted_join(docs, asked, ["scope", "term"], "doc_id", "inner", hot=hot).groupBy("scope", "query_id", "doc_id").agg(F.sum(F.col("_d") * F.col("_q")).alias("_dot"))
    return dots.join(norms, ["scope", "doc_id"]).join(qnorms, ["scope", "query_id"]).select("scope", "query_id", "doc_id", (F.col("_dot") / (F.col("_dn") * F.col("_qn"))).alias("score"))


#: A cell of the grid holds about so many documents and queries at most.
CELL_DOCS, CELL_QUERIES = 65536, 4096
#: With fewer documents, slices are made for all tasks, but of no fewer than this.
LEAST_DOCS = 32768
#: Up to so many terms go to the tasks (about 40 MB; each 64 bytes of a long one count as a term); postings are joined to more.
BROADCAST_TERMS = 1_000_000
#: Documents are worked through in lots of about so many terms.
LOT = 1_000_000


def tfidf_top(corpus: DataFrame, queries: DataFrame, k: int, terms: Terms = X.terms, sublinear: bool = False, digits: int = 6) -> DataFrame:
    """The best ``k`` of each query by :func:`tfidf`, as :func:`top_k` gives them, exact.

    For scopes so large that the pairs of queries and documents that share a
    term are too many to be rows. Sparse vectors meet in a grid of slices of
    documents and parts of queries; a cell scores in arrays the documents that
    can be among the best and sends the best ``k`` of each query on, so what is
    shuffled follows the number of cells, not of pairs. Cells are bounded,
    whatever the size of a scope.

    ``corpus`` has one row for each document. A term that one document has and
    no query asks for only adds to that document's norm, so the vocabulary
    leaves it out.
    """

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if docs.num_rows and asked.num_rows:
            docs = docs.sort_by("doc_id")  # by bytes, as Spark does
            found = _best_of_cell(_sparse(docs, "counts"), docs["norm"].to_numpy(), _sparse(asked, "weights", "idfs"), k, digits, sublinear)
        return pa.table({"query_id": asked["query_id"].take(pa.array(found[0])), "doc_id": docs["doc_id"].take(pa.array(found[1])), "score": found[2]})

    # both are written, as they are counted and then weighed: tokenising twice costs more
    texts = cut(corpus.where("scope is not null").select("scope", "doc_id", terms(F.col("text")).alias("terms")), "terms")
    asked = cut(query_terms(queries, terms), "asked")
    sizes = cut(texts.groupBy("scope").agg(F.count(F.lit(1)).alias("n_docs")), "sizes")
    idf = lambda df: F.log((1 + F.col("n_docs")) / (1 + df)) + 1
    seen = texts.select("scope", F.explode(F.array_distinct("terms")).alias("term"), F.lit(1).alias("_d"), F.lit(0).alias("_q")).where("term is not null")
    seen = seen.unionByName(asked.select("scope", "term", F.lit(0).alias("_d"), F.lit(1).alias("_q"))).groupBy("scope", "term").agg(F.sum("_d").alias("df"), F.max("_q").alias("_q"))
    seen = seen.where("df > 1 or df = 1 and _q = 1").join(F.broadcast(sizes), "scope")
    # terms that some query asks for get a number; written, as numbers must stay
    known = cut(seen.select("scope", "term", idf(F.col("df")).alias("idf"), F.when(F.col("_q") == 1, F.monotonically_increasing_id()).alias("number")), "idf")
    damp = (lambda c: 1 + F.log(c)) if sublinear else (lambda c: c)
    if (known.agg(F.sum(1 + F.floor(F.octet_length("term") / 64))).first()[0] or 0) <= BROADCAST_TERMS:
        docs = _vectors_by_lookup(texts, known, sizes.withColumn("idf", idf(F.lit(1))), sublinear)
    else:
        # the norm is that of all terms, the vector has those asked for
        every = cut(texts.select("scope", "doc_id", F.explode("terms").alias("term")).where("term is not null").groupBy("scope", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
        hot = cut(hot_keys(every, ["scope", "term"]), "hot-terms")
        met = salted_join(every, known, ["scope", "term"], "doc_id", hot=hot).join(F.broadcast(sizes), "scope")
        met = met.where("doc_id is not null").withColumn("_w", damp(F.col("tf")) * F.coalesce("idf", idf(F.lit(1))))
        met = met.groupBy("scope", "doc_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("norm"), F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "tf"))).alias("_v"))
        docs = met.where(F.size("_v") > 0).select("scope", "doc_id", "norm", F.col("_v.number").alias("numbers"), F.col("_v.tf").alias("counts"))
    asked = asked.where("query_id is not null").join(known.where("number is not null"), ["scope", "term"]).groupBy("scope", "query_id")
    asked = cut(asked.agg(F.collect_list(F.struct("number", (damp(F.col("qtf")) * F.col("idf")).alias("weight"), "idf")).alias("_v")), "queries")

    tasks = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = sizes.join(asked.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("parts")), "scope")
    slices = F.greatest(F.ceil(F.col("n_docs") / CELL_DOCS), F.least(F.ceil(2 * tasks / F.col("parts")), F.ceil(F.col("n_docs") / LEAST_DOCS))).cast("int")
    grid = F.broadcast(grid.select("scope", slices.alias("slices"), "parts"))
    place = lambda ident, n: F.pmod(F.xxhash64(ident), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    docs = docs.join(grid, "scope").select("scope", place("doc_id", "slices").alias("slice"), each("parts").alias("part"), "doc_id", "norm", "numbers", "counts")
    vector = [F.col("_v.number").alias("numbers"), F.col("_v.weight").alias("weights"), F.col("_v.idf").alias("idfs")]
    asked = asked.join(grid, "scope").select("scope", each("slices").alias("slice"), place("query_id", "parts").alias("part"), "query_id", *vector)
    cell = ["scope", "slice", "part"]
    return top_k(docs.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(run, "query_id string, doc_id string, score double"), k, digits)


def _vectors_by_lookup(texts: DataFrame, known: DataFrame, rare: DataFrame, sublinear: bool) -> DataFrame:
    """``(scope, doc_id, norm, numbers, counts)`` of documents with a term that is asked for.

    The terms of ``known(scope, term, idf, number)`` go to all tasks; any other
    has the idf that ``rare`` gives for its scope.
    """
    context = texts.sparkSession.sparkContext
    rare, known = rare.select("scope", "idf").toArrow(), known.toArrow()
    scopes = rare["scope"].combine_chunks()
    number = known["number"].fill_null(-1).to_numpy()
    vocabulary = context.broadcast((scopes, rare["idf"].to_numpy(), _keys(pc.index_in(known["scope"], value_set=scopes), known["term"]), known["idf"].to_numpy(), number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: list[pa.RecordBatch] = []
        for batch in batches:
            lot.append(batch)
            if sum(len(b.column(2).flatten()) for b in lot) >= LOT:
                yield from _weigh(pa.Table.from_batches(lot), *vocabulary.value, sublinear).to_batches()
                lot = []
        if lot:
            yield from _weigh(pa.Table.from_batches(lot), *vocabulary.value, sublinear).to_batches()

    return texts.where("doc_id is not null").mapInArrow(run, "scope string, doc_id string, norm double, numbers array<long>, counts array<long>")


def _keys(scope: pa.Array | pa.ChunkedArray, term: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Scopes, given by number, and terms as one text."""
    keys = pc.binary_join_element_wise(scope.cast(pa.string()), term, "\0")
    return keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys


def _weigh(texts: pa.Table, scopes: pa.Array, rare: np.ndarray, keys: pa.Array, idf: np.ndarray, number: np.ndarray, sublinear: bool) -> pa.Table:
    """The vectors of a lot of texts, see :func:`_vectors_by_lookup`."""
    lists = texts["terms"].combine_chunks()
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row, term = np.repeat(np.arange(len(lengths)), lengths), lists.flatten()
    if term.null_count:
        row, term = row[term.is_valid().to_numpy(zero_copy_only=False)], term.drop_null()
    coded, scope = term.dictionary_encode(), pc.index_in(texts["scope"], value_set=scopes).to_numpy().astype(np.int64)
    words = max(1, len(coded.dictionary))
    pair, tf = np.unique(row * words + coded.indices.to_numpy(), return_counts=True)
    row, code = np.divmod(pair, words)
    # each term of each scope is looked up once
    pair, at = np.unique(scope[row] * words + code, return_inverse=True)
    of, code = np.divmod(pair, words)
    at = pc.index_in(_keys(pa.array(of), coded.dictionary.take(pa.array(code))), value_set=keys).fill_null(-1).to_numpy()[at]
    weight = np.where(at >= 0, np.append(idf, 0.0)[at], rare[scope[row]]) * (1 + np.log(tf) if sublinear else tf)
    norm = np.sqrt(np.bincount(row, weight * weight, len(lengths)))
    number = np.append(number, -1)[at]
    wanted = number >= 0
    row, number, tf = row[wanted], number[wanted], tf[wanted]
    count = np.bincount(row, minlength=len(lengths))
    some = np.flatnonzero(count)
    ends = pa.array(np.append(0, np.cumsum(count[some])).astype(np.int32))
    kept = texts.select(["scope", "doc_id"]).take(pa.array(some))
    return pa.table({"scope": kept["scope"], "doc_id": kept["doc_id"], "norm": norm[some], "numbers": pa.ListArray.from_arrays(ends, pa.array(number, pa.int64())), "counts": pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))})


def _sparse(rows: pa.Table, *values: str) -> tuple:
    """``(row, number, *values)`` of all entries of sparse vectors in order of rows, and the number of rows."""
    numbers = rows["numbers"].combine_chunks()
    lengths = numbers.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lengths)), lengths), *(rows[c].combine_chunks().flatten().to_numpy() for c in ("numbers", *values)), len(lengths)


#: Slack of the bounds by which documents are left out, far above any error of their sums; the last digit of scores comes on top.
_SLACK = 1e-9


def _best_of_cell(docs: tuple, norms: np.ndarray, asked: tuple, k: int, digits: int, sublinear: bool) -> list[np.ndarray]:
    """``[query, document, score]`` of the first ``k`` of each query by score rounded to ``digits``, then place among the documents.

    A query's terms are taken from the rarest on. What those not yet taken can
    add to a score is bounded; once that is less than the ``k``-th best has
    already, no other document can get there, and only those that still can
    are scored by their other terms too.
    """
    query, wanted, qweight, idf, n_queries = asked
    held, number, tf, n = docs
    # terms of the cell, with the postings of each
    known, first = np.unique(wanted, return_index=True)
    idf = idf[first]
    at = np.minimum(np.searchsorted(known, number), len(known) - 1)
    met = known[at] == number
    held, at, tf = held[met], at[met], tf[met]
    weight = (1 + np.log(tf) if sublinear else tf) * idf[at] / norms[held]
    # entries in order of documents, to complete some of them
    rows = np.searchsorted(held, np.arange(n + 1))
    row_term, row_weight = at, weight
    order = np.argsort(at, kind="stable")
    held, weight = held[order], weight[order]
    start = np.searchsorted(at[order], np.arange(len(known) + 1))
    size = np.diff(start)
    most = np.zeros(len(known))
    some = np.flatnonzero(size)
    if len(some):
        most[some] = np.maximum.reduceat(weight, start[some])

    qweight = qweight / np.sqrt(np.bincount(query, qweight * qweight, n_queries))[query]
    term = np.searchsorted(known, wanted)
    query, term, qweight = (x[size[term] > 0] for x in (query, term, qweight))
    order = np.lexsort((size[term], query))
    query, term, qweight = query[order], term[order], qweight[order]
    bounds = np.searchsorted(query, np.arange(n_queries + 1))
    slack = _SLACK + 10.0**-digits
    few = max(k, n // 512)
    slot, by_term = np.zeros(n, np.int64), np.zeros(len(known))

    def partial(terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that have any of the terms, and their sums."""
        where = [slice(start[t], start[t + 1]) for t in terms]
        near = np.concatenate([held[s] for s in where])
        products = np.concatenate([weight[s] * w for s, w in zip(where, weights)])
        entry = np.arange(len(near))
        slot[near] = entry
        mine = slot[near]  # one entry stands for all of its document
        once = mine == entry
        return near[once], np.bincount(mine, products, len(near))[once]

    out: list[list[np.ndarray]] = [[], [], []]
    for q in range(n_queries):
        lo, hi = bounds[q], bounds[q + 1]
        if lo == hi:
            continue
        mine, weights = term[lo:hi], qweight[lo:hi]
        # what the terms from each place on can add at most
        rest = np.append(np.cumsum((weights * most[mine])[::-1])[::-1], 0.0)
        taken = max(1, int(np.searchsorted(np.cumsum(size[mine]), few, "right")))
        while True:
            near, sums = partial(mine[:taken], weights[:taken])
            least = np.partition(sums, -k)[-k] - slack if len(sums) >= k else 0.0
            more = int(np.argmax(rest < least)) if rest[-1] < least else hi - lo
            if more <= taken:
                break
            taken = more
        if taken < hi - lo:
            near = near[sums >= least - rest[taken]]
            by_term[mine] = weights
            begin, length = rows[near], rows[near + 1] - rows[near]
            ends = np.cumsum(length)
            entry = np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)
            sums = np.add.reduceat(by_term[row_term[entry]] * row_weight[entry], ends - length)
            by_term[mine] = 0.0
        scores = np.floor(sums * 10.0**digits + 0.5)
        keep = np.arange(len(near))
        if len(near) > k:
            keep = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        keep = keep[np.lexsort((near[keep], -scores[keep]))[:k]]
        for column, values in zip(out, (np.full(len(keep), q), near[keep], scores[keep] / 10.0**digits)):
            column.append(values)
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64))]


def top_k(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The best ``k`` of each query as ``(query_id, rank, doc_id, score)``: by score rounded to ``digits``, then id.

    Spark cuts each partition to ``k`` rows of a query before the shuffle (WindowGroupLimit).
    """
    rows = scores.select("query_id", "doc_id", F.round("score", digits).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


BLOCK = 2048


def _blocks(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """Rows gathered into matrices of up to ``BLOCK`` vectors of one scope: ``(scope, ids, matrix)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scopes, ids, rows = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
            for scope in dict.fromkeys(scopes):
                at = [i for i, s in enumerate(scopes) if s == scope]
                for start in range(0, len(at), BLOCK):
                    part = at[start : start + BLOCK]
                    matrix = np.array(rows.take(pa.array(part)).to_pylist(), np.float64)
                    columns = [pa.array([scope]), pa.array([ids[part].tolist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["scope", "ids", "matrix"])

    rows = vectors.select(F.col("scope").cast("string").alias("scope"), F.col(ident).cast("bigint").alias("id"), vector).where(F.col(vector).isNotNull())
    return rows.mapInArrow(run, "scope string, ids array<long>, matrix binary")


def dense(corpus: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding", skip_self: bool = True) -> DataFrame:
    """Cosine similarity within each scope, exact: the best ``k`` of each query as ``top_k`` gives them.

    ``corpus`` and ``queries`` hold ``scope``, ``ident`` and ``vector``.
    Queries and corpus meet in blocks of matrices, spread over all tasks by
    slices of the corpus even if all have one scope, and each pair of blocks is
    cut to ``k`` a query, so what is shuffled follows the number of blocks, not
    of pairs. Vectors of no length are similar to nothing (0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qids, ids = np.array(row["qids"], np.int64), np.array(row["ids"], np.int64)
                q = np.frombuffer(row["qmatrix"]).reshape(len(qids), -1)
                c = np.frombuffer(row["matrix"]).reshape(len(ids), -1)
                unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
                scores = unit(q) @ unit(c).T
                if skip_self:
                    scores[qids[:, None] == ids[None, :]] = -np.inf
                # ties at the edge of a block's best are all kept, the window decides
                rounded = np.round(scores, 6)
                least = np.sort(rounded, axis=1)[:, -min(k, rounded.shape[1])][:, None]
                a, b = np.nonzero((rounded >= least) & np.isfinite(scores))
                yield pa.RecordBatch.from_arrays([pa.array(qids[a]), pa.array(ids[b]), pa.array(scores[a, b])], names=["query_id", "doc_id", "score"])

    # a grid: the blocks of a scope are dealt to slices, and each block of queries goes to every slice of its scope
    tasks = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = F.least(F.lit(2 * tasks), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int")
    scopes = corpus.groupBy(F.col("scope").cast("string").alias("scope")).agg(slices.alias("slices"))
    asked = _blocks(queries, ident, vector).join(scopes, "scope")
    asked = asked.select("scope", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"))
    held = _blocks(corpus, ident, vector).join(scopes, "scope").withColumn("slice", F.pmod(F.xxhash64("ids"), F.col("slices")).cast("int")).drop("slices")
    met = asked.join(held, ["scope", "slice"])
    return top_k(met.mapInArrow(run, "query_id long, doc_id long, score double"), k)


def graph_features(edges: DataFrame) -> DataFrame:
    """``(scope, doc_id, token, is_entity, is_relation)``: the tokens of a memory's edges, from ``edges(scope, doc_id, src_id, relation, dst_id)``.

    In long form, so that a memory with very many edges is no large value.
    """
    entity = edges.select("scope", "doc_id", F.explode_outer(F.concat(X.tokens(F.col("src_id")), X.tokens(F.col("dst_id")))).alias("token"), F.lit(1).alias("e"), F.lit(0).alias("r"))
    relation = edges.select("scope", "doc_id", F.explode_outer(X.tokens(F.col("relation"))).alias("token"), F.lit(0).alias("e"), F.lit(1).alias("r"))
    return entity.unionByName(relation).where("token is not null").groupBy("scope", "doc_id", "token").agg(F.max("e").alias("is_entity"), F.max("r").alias("is_relation"))


# fixed values: the weights of the query-graph score under four configurations, of which B is the usual one
GRAPH_CONFIGS = {
    "config_A": {"entity": 0.40, "relation": 0.25, "text": 0.20, "temporal": 0.10, "multi_entity": 0.05},
    "config_B": {"entity": 0.50, "relation": 0.20, "text": 0.15, "temporal": 0.10, "multi_entity": 0.05},
    "config_C": {"entity": 0.30, "relation": 0.20, "text": 0.20, "temporal": 0.25, "multi_entity": 0.05},
    "config_D": {"entity": 0.35, "relation": 0.30, "text": 0.15, "temporal": 0.10, "multi_entity": 0.10},
}
GRAPH_WEIGHTS = GRAPH_CONFIGS["config_B"]


def graph_shares(features: DataFrame, queries: DataFrame) -> DataFrame:
    """``(scope, query_id, doc_id, entity, relation, text, temporal, multi_entity)`` of memories that share a token with a query.

    Shares of the query's distinct tokens found among the memory's entity,
    relation and all tokens, whether both are temporal, and whether they share
    two entities (1 or 0).
    """
    rows = queries.select("scope", "query_id", F.array_distinct(X.tokens(F.col("text"))).alias("_t"))
    rows = rows.select("scope", "query_id", F.size("_t").alias("n"), X.is_temporal(F.col("_t")).alias("temporal"), F.size(F.filter("_t", X.is_entity_like)).alias("entities"), F.explode("_t").alias("token"))
    # written, as they are counted for hot tokens, joined, and searched for temporal ones
    features = cut(features, "features")
    temporal = features.where(F.col("token").isin(*X.TEMPORAL_WORDS)).select("scope", "doc_id").distinct().withColumn("_timed", F.lit(True))
    met = salted_join(features, rows, ["scope", "token"], "doc_id", "inner").groupBy("scope", "query_id", "doc_id", "n", "temporal", "entities")
    met = met.agg(F.sum("is_entity").alias("e"), F.sum("is_relation").alias("r"), F.count(F.lit(1)).alias("a"), F.sum(F.when(X.is_entity_like(F.col("token")), F.col("is_entity")).otherwise(0)).alias("ee"))
    met = met.join(temporal, ["scope", "doc_id"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    share = lambda c: F.col(c) / F.col("n")
    return met.select("scope", "query_id", "doc_id", share("e").alias("entity"), share("r").alias("relation"), share("a").alias("text"), flag(F.col("temporal") & F.col("_timed")).alias("temporal"), flag((F.col("entities") >= 2) & (F.col("ee") >= 2)).alias("multi_entity"))


def graph_score(weights: dict[str, float]) -> Column:
    """The weighted sum of the shares, between 0 and 1."""
    parts = [F.lit(weights[name]) * F.col(name) for name in ("entity", "relation", "text", "temporal", "multi_entity")]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum(parts[1:], parts[0])))


def graph_scores(features: DataFrame, queries: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """How well the edges of a memory answer a query, 0 to 1: ``(scope, query_id, doc_id, kg_score)`` of memories that share a token."""
    return graph_shares(features, queries).select("scope", "query_id", "doc_id", graph_score(weights or GRAPH_WEIGHTS).alias("kg_score"))
