"""Sparse cosine retrieval on posting tables.

A text column becomes terms with weights (1 + ln tf) * idf, rows scaled to unit length; the idf,
ln((1 + n) / (1 + df)) + 1, is that of the pool alone. A cosine is the sum, over shared terms, of
the products of weights; terms in more than max_df of the pool are dropped first.

Given pairs get their cosine by equi-joins of postings on the term. A search has no pairs yet, and a
join on the term would list one row for each shared term of each pair, which grows with the square
of the data. So terms are hashed to 64 bits and only counted by shuffle; texts become vectors of
numbers and counts where they are read, and each vector is shuffled once, to lie in files: the pool in
chunks, the queries in groups of a bounded number of postings. A task keeps one group, reads the
chunks past it one by one, adds up each query over them with numpy, and returns the k best. Equal
vectors are compared once: a vector of the pool has its k first ids, one of the queries all of its.
Two terms of one hash would count as one: for n distinct terms n ** 2 / 2 ** 65, 3e-5 for 30 million.

`part` columns (country) belong to the key of every step: one plan serves all countries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from ..functions.text import char_pieces
from ..storage import arrow, dropped, read_batches, read_table, staged

#: Digits that scores are rounded to before they are ranked.
DIGITS = 6


def words(c: Column) -> Column:
    """Terms parted by spaces."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def word_pairs(c: Column) -> Column:
    """Terms and pairs of neighbouring terms."""

    def both(w: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
        return F.when(F.size(w) > 1, F.concat(w, two)).otherwise(w)

    # Bound to a name: else the text would be split anew for every pair.
    return F.element_at(F.transform(F.array(words(c)), both), 1)


def char_grams(n: int) -> Callable[[Column], Column]:
    """Pieces of n letters; none of a shorter text."""

    def grams(c: Column) -> Column:
        return F.when(F.char_length(c) >= n, char_pieces(c, n)).otherwise(F.array().cast("array<string>"))

    return grams


@dataclass(frozen=True)
class Block:
    """One way to retrieve: the text, its terms, which pool rows count, and how many to return."""

    name: str
    text: str
    k: int
    max_df: float
    min_df: int = 2
    min_score: float = 0.0
    terms: Callable[[Column], Column] = words
    pool_filter: str | None = None
    small_pool: int = 100


def counts(df: DataFrame, id_col: str, text: str, terms: Callable[[Column], Column], part: list[str]) -> DataFrame:
    """(part, id, term, tf)."""
    return df.select(*part, F.col(id_col).alias("id"), F.explode(terms(F.col(text))).alias("term")).groupBy(*part, "id", "term").agg(F.count("*").alias("tf"))


def idf_table(pool: DataFrame, pool_counts: DataFrame, block: Block, part: list[str]) -> DataFrame:
    """(part, term, idf) of the terms that stay. In a pool of at most `small_pool` rows no term is
    too common, and in one of a single row none too rare; if nothing would stay, all terms do."""
    n = pool.groupBy(*part).agg(F.count("*").alias("n"))
    df = pool_counts.groupBy(*part, "term").agg(F.count("*").alias("df")).join(F.broadcast(n), part)  # a row for each country
    most = F.when(F.col("n") > block.small_pool, F.col("n") * block.max_df).otherwise(F.col("n"))
    df = df.withColumn("keep", (F.col("df") >= F.least(F.lit(block.min_df), F.col("n"))) & (F.col("df") <= most))
    any_kept = df.groupBy(*part).agg(F.max("keep").alias("some"))
    df = df.join(F.broadcast(any_kept), part).where(F.col("keep") | ~F.col("some"))
    return df.select(*part, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(tf: DataFrame, idf: DataFrame, part: list[str]) -> DataFrame:
    """(part, id, term, w): unit rows; terms without an idf are dropped first. The terms of a text are
    gathered once, with their norm, and listed again."""
    raw = tf.join(idf, [*part, "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    rows = raw.groupBy(*part, "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("x"))
    return rows.select(*part, "id", "norm", F.inline("x")).select(*part, "id", "term", (F.col("w") / F.col("norm")).alias("w"))


def posting_tables(queries: DataFrame, pool: DataFrame, block: Block, part: list[str], query_id: str, pool_id: str, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Weights of the queries and of the pool under one block. The counts of the pool and the idf are
    written out: both are read several times, and texts are taken apart once. `whole` is the pool that
    the idf is of, where `pool` has one record of each text of it."""
    if block.pool_filter:
        pool, whole = pool.where(block.pool_filter), None if whole is None else whole.where(block.pool_filter)
    p = staged(counts(pool, pool_id, block.text, block.terms, part), "counts")
    every = p if whole is None else counts(whole, pool_id, block.text, block.terms, part)
    idf = staged(idf_table(pool if whole is None else whole, every, block, part), "idf")
    return weights(counts(queries, query_id, block.text, block.terms, part), idf, part), weights(p, idf, part)


#: Postings of a pool chunk (one is kept in a task at a time) and of a group of queries (kept in a task);
#: terms that a task numbers at a time; equal queries that travel in one row.
CHUNK, GROUP, BATCH, COPIES = 1 << 20, 1 << 19, 1 << 20, 1000


def _order(i) -> tuple:
    """Ids in the order of the database: nulls first."""
    return (i is not None, i)


def _flat(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def _numbers(files: list[str], ids: int):
    """Rows (p, id, h) become (p, key, ids, no, tf, df): the numbers of the kept terms of a text in
    order, with both counts. Equal vectors of a batch are one row, with the first `ids` ids; key is a
    128-bit digest of the vector. Kept terms are read file by file, each in the order of h."""

    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        p, names, lists = (rows.column(i).combine_chunks() if isinstance(rows.column(i), pa.ChunkedArray) else rows.column(i) for i in range(3))
        some, place = np.unique(_flat(lists), return_inverse=True)
        no, df, total = np.full(len(some), -1, np.int64), np.zeros(len(some), np.int32), 0
        for f in files:
            t = read_table(f, ["h", "df"])
            h = t.column("h").to_numpy()
            if len(h) and len(some):
                at = np.minimum(np.searchsorted(h, some), len(h) - 1)
                hit = h[at] == some
                no[hit], df[hit] = total + at[hit], t.column("df").to_numpy()[at[hit]]
            total += len(h)
        if total >= 1 << 31:
            raise ValueError("more than 2 ** 31 terms are kept")
        known = no[place]
        kept = np.flatnonzero(known >= 0)
        row = np.repeat(np.arange(rows.num_rows), _sizes(lists))[kept]
        codes, first, tf = np.unique(row * max(total, 1) + known[kept], return_index=True, return_counts=True)
        row, no, tf, df = row[first], (codes % max(total, 1)).astype(np.int32), tf.astype(np.int32), df[place[kept[first]]]
        there, start = np.unique(row, return_index=True)
        ends = np.append(start, len(row))
        part, names = p.to_pylist(), names.to_pylist()
        found: dict[tuple, list] = {}
        for i, r in enumerate(there.tolist()):
            s = slice(ends[i], ends[i + 1])
            key = hashlib.blake2b(no[s].tobytes() + tf[s].tobytes(), digest_size=16).digest()
            found.setdefault((part[r], key), [s, []])[1].append(names[r])
        todo, n = [], 0
        for (q, key), (s, who) in found.items():
            who = sorted(who, key=_order)[:ids] if ids < len(who) else who
            todo.append((q, key, who, s))
            n += s.stop - s.start + len(who)
            if n >= 1 << 20:
                yield out(todo, no, tf, df, held[0].schema.field(1).type)
                todo, n = [], 0
        if todo:
            yield out(todo, no, tf, df, held[0].schema.field(1).type)

    def out(todo: list[tuple], no: np.ndarray, tf: np.ndarray, df: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *(s.stop - s.start for *_, s in todo)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[s] for *_, s in todo]))) for x in (no, tf, df)]
        return pa.record_batch([pa.array([x[0] for x in todo], pa.int32()), pa.array([x[1] for x in todo], pa.binary()), pa.array([x[2] for x in todo], pa.list_(kind)), *lists], names=["p", "key", "ids", "no", "tf", "df"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            ends = b.column(2).offsets.to_numpy()
            start = 0
            while start < b.num_rows:
                end = max(start + 1, int(np.searchsorted(ends, ends[start] + BATCH - n, "right")) - 1)
                held.append(b.slice(start, end - start))
                n += int(ends[end] - ends[start])
                start = end
                if start < b.num_rows or n >= BATCH:
                    yield from one(held)
                    held, n = [], 0
        if held:
            yield from one(held)

    return kernel


def _classes(ids: int, whole: bool):
    """Rows in the order of (p, key) become one for each vector, with its first `ids` ids; or, if the
    ids are to be whole, one for each `ids` of them."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, row, who = None, None, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            t = pa.Table.from_batches([r for r, _ in rows]).combine_chunks()
            t = t.set_column(2, t.schema.field(2), pa.array([w for _, w in rows], t.schema.field(2).type))
            return t.to_batches()[0]

        def parts(row: pa.RecordBatch, who: list) -> list[tuple]:
            who = sorted(who, key=_order)
            return [(row, who[i : i + ids]) for i in range(0, len(who) if whole else 1, ids)]

        for b in batches:
            done = []
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if key != last:
                    if row is not None:
                        done += parts(row, who)
                    last, row, who = key, b.slice(i, 1), []
                who += b.column(2)[i].as_py()
                if whole and len(who) > 2 * ids:
                    done += parts(row, who[: len(who) // ids * ids])
                    who = who[len(who) // ids * ids :]
                    if not who:
                        last, row = None, None
                elif not whole and len(who) > 8 * ids:
                    who = sorted(who, key=_order)[:ids]
                if len(done) >= 2048:
                    yield out(done)
                    done = []
            if done:
                yield out(done)
        if row is not None and who:
            yield out(parts(row, who))

    return kernel


def _unit(no: pa.ListArray, tf: pa.ListArray, df: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, numbers, weights) of vectors of unit length."""
    sizes, w = _sizes(no), 1 + np.log(_flat(tf))
    w *= np.log((1 + n) / (1 + _flat(df))) + 1
    if len(sizes):
        w /= np.repeat(np.sqrt(np.add.reduceat(w * w, np.cumsum(sizes) - sizes)), sizes)
    return sizes, _flat(no), w


class Postings:
    """The postings of a pool chunk by term, of the terms that are asked for (in order)."""

    def __init__(self, asked: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights_: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(asked, terms), max(0, len(asked) - 1))
        mine = np.flatnonzero(asked[at] == terms) if len(asked) else np.zeros(0, int)
        mine = mine[np.argsort(at[mine], kind="stable")]
        self.size = len(sizes)
        self.rows = np.repeat(np.arange(len(sizes)), sizes)[mine]
        self.weights = weights_[mine]
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(at[mine], minlength=len(asked)))))

    def best(self, at: np.ndarray, weights_: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k rows of largest rounded score above `least`; of equals the first. The
        query is given by the places of its terms among those asked for."""
        start, n = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        score = np.round(np.bincount(self.rows[place], self.weights[place] * np.repeat(weights_, n), self.size), DIGITS)
        found = np.flatnonzero(score > max(least, 0.0))
        if len(found) > k:
            found = found[score[found] >= -np.partition(-score[found], k - 1)[k - 1]]
            found = np.sort(found[np.argsort(-score[found], kind="stable")[:k]])
        return found, score[found]


def _pieces(files: list[str]) -> Iterator[pa.Table]:
    """The pool's rows, about a chunk of postings at a time, in the order of their first ids."""
    held, n = [], 0
    for f in files:
        for b in read_batches(f, ["ids", "no", "tf", "df"], 4096):
            held.append(b)
            n += len(b.column(1).flatten())
            if n >= CHUNK:
                yield _by_id(held)
                held, n = [], 0
    if held:
        yield _by_id(held)


def _by_id(held: list[pa.RecordBatch]) -> pa.Table:
    t = pa.Table.from_batches(held).combine_chunks()
    first = [x[0].as_py() for x in t.column("ids").combine_chunks()] if t.num_rows else []
    return t.take(pa.array(sorted(range(len(first)), key=lambda i: _order(first[i])), pa.int64())).combine_chunks()


def _search(tasks: list[tuple[int, str]], pools: dict[int, list[str]], sizes_: dict[int, int], k: int, least: float):
    """A row is the number of a task: a file of queries, held, past which the pool goes in chunks."""

    def lists(t: pa.Table, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _unit(*(t.column(c).combine_chunks() for c in ("no", "tf", "df")), sizes_[p])

    def merged(found: list[tuple]) -> list[tuple]:
        """The k first rows of classes (-score, first id, ids)."""
        found.sort(key=lambda x: (x[0], _order(x[1])))
        rows: list[tuple] = []
        for score, _, ids in found:
            if len(rows) >= k and score > rows[-1][0]:
                break
            rows += [(score, i) for i in ids]
        return sorted(rows, key=lambda x: (x[0], _order(x[1])))[:k]

    def one(p: int, file: str) -> Iterator[tuple]:
        t = read_table(file, ["ids", "no", "tf", "df"])
        sizes, terms, w = lists(t, p)
        asked, at = np.unique(terms, return_inverse=True)
        ends = np.concatenate(([0], np.cumsum(sizes))).tolist()
        best: list[list[tuple]] = [[] for _ in sizes]
        for piece in _pieces(pools.get(p, [])):
            ids = piece.column("ids").combine_chunks()
            index = Postings(asked, *lists(piece, p))
            for q, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
                rows, scores = index.best(at[i:j], w[i:j], k, least)
                if len(rows):
                    best[q] += [(-s, x[0], x) for s, x in zip(scores.tolist(), ids.take(pa.array(rows)).to_pylist(), strict=True)]
                    if len(best[q]) > 2 * k:
                        best[q] = sorted(best[q], key=lambda x: (x[0], _order(x[1])))[:k]
        yield from zip(t.column("ids").to_pylist(), map(merged, best), strict=True)

    def kernel(kinds: tuple[pa.DataType, pa.DataType]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out() -> pa.RecordBatch:
                return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], kinds[0]), pa.array(cols[2], kinds[1]), pa.array(cols[3], pa.float64())], names=["p", "q_id", "p_id", "score"])

            for b in batches:
                for task in b.column(0).to_pylist():
                    p, file = tasks[task]
                    cols: list[list] = [[], [], [], []]
                    for who, found in one(p, file):
                        for q in who:
                            cols[0] += [p] * len(found)
                            cols[1] += [q] * len(found)
                            cols[2] += [i for _, i in found]
                            cols[3] += [-s for s, _ in found]
                            if len(cols[0]) >= 1 << 16:
                                yield out()
                                cols = [[], [], [], []]
                    if cols[0]:
                        yield out()

        return run

    return kernel


def _hashed(d: DataFrame, plan: DataFrame, block: Block, part: list[str], id_col: str, merge: bool) -> DataFrame:
    """(p, id, h): 64-bit hashes of the terms of each text; rows of one id are one text."""
    d = d.join(F.broadcast(plan), part) if part else d.crossJoin(F.broadcast(plan))  # a row for each value of part
    d = d.select("p", F.col(id_col).alias("id"), F.transform(block.terms(F.col(block.text)), lambda t: F.xxhash64("p", t)).alias("h"))
    if merge:
        d = d.groupBy("p", "id").agg(F.flatten(F.collect_list("h")).alias("h"))
    return d.where(F.size("h") > 0)


def _rows(d: DataFrame, part: list[str], id_col: str) -> list:
    """(part, n, most): rows for each value of part, and the most that one id has."""
    per = d.groupBy(*part, F.col(id_col).alias("_id")).agg(F.count("*").alias("_n"))
    return per.groupBy(*part).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.max("_n"), F.lit(0)).alias("most")).collect()


def _dealt(d: DataFrame, files: list[str], groups: dict[int, int], ids: int, whole: bool, name: str) -> DataFrame:
    """Vectors of d, equal ones together, in a folder for each p and about as many files as groups."""
    spark, kind = d.sparkSession, d.schema["id"].dataType
    ints = ArrayType(IntegerType())
    schema = StructType([StructField("p", IntegerType()), StructField("key", BinaryType()), StructField("ids", ArrayType(kind)), StructField("no", ints), StructField("tf", ints), StructField("df", ints)])
    share = spark.createDataFrame(list(groups.items()), "p int, _g int")
    rows = arrow(d, _numbers(files, COPIES if whole else ids), schema).join(F.broadcast(share), "p").withColumn("_c", F.pmod(F.xxhash64("key"), F.col("_g")))
    rows = rows.repartition(max(1, sum(groups.values())), "p", "_c").sortWithinPartitions("p", "key").select(*schema.names)
    return staged(arrow(rows, _classes(ids, whole), schema), name, ("p",), "zstd")


def top_k(queries: DataFrame, pool: DataFrame, block: Block, part: list[str] | None = None, query_id: str = "entity_id", pool_id: str = "entity_id") -> DataFrame:
    """(part, q_id, p_id, score, rank): for each query the k pool rows of largest cosine above
    min_score; ties by the pool id."""
    part = ["country"] if part is None else part
    spark = queries.sparkSession
    for c in part:
        queries, pool = queries.where(F.col(c).isNotNull()), pool.where(F.col(c).isNotNull())
    if block.pool_filter:
        pool = pool.where(block.pool_filter)
    held, asking = _rows(pool, part, pool_id), _rows(queries, part, query_id)
    n = {i: r["n"] for i, r in enumerate(held)}
    plan = spark.createDataFrame([(*r[: len(part)], i) for i, r in enumerate(held)], StructType([*(pool.schema[c] for c in part), StructField("p", IntegerType())]))
    texts = _hashed(pool, plan, block, part, pool_id, any(r["most"] > 1 for r in held))
    # Terms that stay, as in idf_table.
    seen = texts.select("p", F.explode(F.array_distinct("h")).alias("h")).groupBy("p", "h").agg(F.count("*").cast("int").alias("df"))
    rarest = spark.createDataFrame([(i, min(block.min_df, m), float(m * block.max_df if m > block.small_pool else m)) for i, m in n.items()], "p int, _least long, _most double")
    stay = lambda d, name: staged(d.sortWithinPartitions("h"), name)
    terms = [stay(seen.join(F.broadcast(rarest), "p").where("df >= _least and df <= _most").select("p", "h", "df"), "terms")]
    size = lambda d: {r["p"]: r["s"] for r in d.groupBy("p").agg(F.sum("df").alias("s")).collect()}
    postings = size(terms[0])
    if rest := [i for i in n if i not in postings]:
        terms.append(stay(seen.where(F.col("p").isin(rest)), "terms"))
        postings |= size(terms[1])
    files = [f for t in terms for f in t.inputFiles()]
    chunks = {i: -(-s // CHUNK) for i, s in postings.items()}
    # Queries are thought to be as long as pool rows; small tables are dealt to all cores.
    by = {tuple(r[: len(part)]): r["n"] for r in asking}
    long = {i: by.get(tuple(held[i][: len(part)]), 0) * s // max(1, n[i]) + 1 for i, s in postings.items()}
    least = max(1, sum(long.values()) // max(1, spark.sparkContext.defaultParallelism))
    groups = {i: -(-s // min(GROUP, least)) for i, s in long.items()}
    some = spark.createDataFrame([(i,) for i in groups], "p int")
    p = _dealt(texts, files, chunks, block.k, False, "pool")
    asked = _hashed(queries, plan, block, part, query_id, any(r["most"] > 1 for r in asking)).join(F.broadcast(some), "p", "left_semi")
    q = _dealt(asked, files, groups, COPIES, True, "queries")
    for t in terms:
        dropped(t)
    of = lambda d: [(int(f.rsplit("/", 2)[1].partition("=")[2]), f) for f in sorted(d.inputFiles())]
    tasks, pools = of(q), {}
    for i, f in of(p):
        pools.setdefault(i, []).append(f)
    schema = StructType([StructField("p", IntegerType()), StructField("q_id", queries.schema[query_id].dataType), StructField("p_id", pool.schema[pool_id].dataType), StructField("score", DoubleType())])
    kinds = tuple(to_arrow_type(schema[c].dataType) for c in ("q_id", "p_id"))
    pairs = arrow(spark.range(0, len(tasks), 1, max(1, len(tasks))), _search(tasks, pools, n, block.k, block.min_score)(kinds), schema)
    pairs = pairs.join(F.broadcast(plan), "p").select(*part, "q_id", "p_id", "score")
    order = Window.partitionBy(*part, "q_id").orderBy(F.desc("score"), "p_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= block.k)


def pair_cosine(pairs: DataFrame, queries: DataFrame, pool: DataFrame, block: Block, part: list[str] | None = None, query_id: str = "entity_id", pool_id: str = "entity_id", whole: DataFrame | None = None) -> DataFrame:
    """pairs (part, q_id, p_id) with `cosine`: exact, 0 where no term is shared. For `whole` see posting_tables."""
    part = ["country"] if part is None else part
    q, p = posting_tables(queries, pool, block, part, query_id, pool_id, whole)
    left = pairs.select(*part, "q_id", "p_id").distinct().join(q.select(*part, F.col("id").alias("q_id"), "term", F.col("w").alias("wq")), [*part, "q_id"])
    both = left.join(p.select(*part, F.col("id").alias("p_id"), "term", F.col("w").alias("wp")), [*part, "p_id", "term"])
    found = both.groupBy(*part, "q_id", "p_id").agg(F.round(F.sum(F.col("wq") * F.col("wp")), DIGITS).alias("cosine"))
    return pairs.join(found, [*part, "q_id", "p_id"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def union_blocks(found: dict[str, DataFrame], part: list[str] | None = None) -> DataFrame:
    """One row for each pair that any block found, with s_<block> and r_<block>, null where it did
    not: a union and one grouping instead of a chain of full joins."""
    part = ["country"] if part is None else part
    rows = None
    for name, df in found.items():
        one = df.select(*part, "q_id", "p_id", F.lit(name).alias("block"), "score", "rank")
        rows = one if rows is None else rows.unionByName(one)
    out = []
    for name in found:
        mine = F.col("block") == name
        out += [F.max(F.when(mine, F.col("score"))).alias(f"s_{name}"), F.max(F.when(mine, F.col("rank"))).alias(f"r_{name}")]
    return rows.groupBy(*part, "q_id", "p_id").agg(*out, F.count("*").cast("int").alias("n_blocks"))
