"""A persistent inverted index: postings in blocks with their impacts, in generations.

Each generation is a folder of tables. ``blocks`` has a row for a term and a block of
2**``bits`` chunk ids, all of a block in one file: places within the block, counts, lengths, and the block's impacts,
the shortest chunk for each count. BM25 grows with the count and falls with the length, so
the best of the impacts is the block's highest score whatever the mean length has become.
``change`` and ``totals`` hold what the generation adds to document frequencies, chunks and
tokens, as signed numbers; ``killed`` names the older rows that it replaces or deletes. Sums
over generations are therefore those of an index built anew.

A search deals the postings of the queries' terms to tasks by whole blocks. A task bounds its
blocks for all queries, and scores chunks in those alone whose bound reaches the k-th score it
has found so far; no row is made for a query and a block. The result is exact.

A generation counts once its name is in ``manifest``, whose rows are appended last, so a job
that dies leaves the index as it was. There may be one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantaloom.functions.text import tokens
from vantaloom.operators.lexical import K1, TEXTS, WEIGHTS_MB, B, idf
from vantaloom.operators.ranking import top_k
from vantaloom.sources.runtime import arrow_batches, ship_package, small_side, stage

BITS, SEED = 3, 4
ROWS = 8192  # of blocks and terms that a task's Python gets at a time
_SLACK = 2e-6  # sums of the same parts in another order, and scores rounded to six digits

TABLES = {
    "docs": "chunk_id long, digest string, dl int, terms array<string>, tfs array<int>",
    "blocks": "term string, block long, places array<int>, tfs array<int>, dls array<int>, impacts array<struct<tf:int,dl:int>>",
    "change": "term string, n long",
    "killed": "chunk_id long, of string",
    "totals": "n_docs long, n_tokens long",
}


@dataclass
class Postings:
    """An index in a folder that all executors share; ``bits`` and the tokenizer stay as they were when it was made."""

    spark: SparkSession
    path: str
    bits: int = BITS
    tokenizer: object = tokens

    def _manifest(self) -> tuple[int, list[str]]:
        """Version and generations, oldest first; a handful of names."""
        try:
            rows = self.spark.read.schema("version int, folders array<string>").json(f"{self.path}/manifest")
            last = rows.orderBy(F.desc("version")).first()
        except Exception as missing:  # an index without a generation yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            last = None
        return (last["version"], last["folders"]) if last else (0, [])

    def _commit(self, version: int, folders: list[str]) -> None:
        self.spark.createDataFrame([(version, folders)], "version int, folders array<string>").coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _write(self, folder: str, **tables: DataFrame) -> None:
        with arrow_batches(self.spark, TEXTS):
            for name, df in tables.items():
                df.write.parquet(f"{self.path}/{folder}/{name}")

    @property
    def exists(self) -> bool:
        return bool(self._manifest()[1])

    def read(self, name: str) -> DataFrame:
        """A table of all generations, each row with its generation ``gen``."""
        _, folders = self._manifest()
        if not folders:
            return self.spark.createDataFrame([], f"gen string, {TABLES[name]}")
        own = [self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{f}/{name}").select(F.lit(f).alias("gen"), "*") for f in folders]
        return reduce(DataFrame.unionByName, own)

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows of (chunk_id, gen, ...) that no later generation has replaced or deleted."""
        killed = small_side(self.read("killed").select("chunk_id", F.col("of").alias("gen")))
        return rows.join(killed, ["chunk_id", "gen"], "left_anti")

    @property
    def frequency(self) -> DataFrame:
        """(term, df) of the chunks that live; texts and postings are not read."""
        return self.read("change").groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    @property
    def totals(self) -> DataFrame:
        """One row: n_docs and avgdl."""
        return self.read("totals").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.try_divide(F.sum("n_tokens"), F.sum("n_docs")), F.lit(0.0)).alias("avgdl"))

    def apply(self, chunks: DataFrame, deleted: DataFrame | None = None, id_col: str = "chunk_id", text_col: str = "text") -> None:
        """A generation of new and changed chunks and deleted ids.

        Chunks whose text is the same as before cost their hash alone. A null text is empty, rows
        without an id are left out, of rows that repeat an id the one with the least digest counts, and an id
        that is also in ``deleted`` is deleted. Deleting an unknown id does nothing.
        """
        version, folders = self._manifest()
        text = F.coalesce(F.col(text_col), F.lit(""))
        given = chunks.select(F.col(id_col).cast("long").alias("chunk_id"), F.sha1(text.cast("binary")).alias("digest"), text.alias("text")).where("chunk_id is not null")
        gone = (deleted.select(F.col(id_col).cast("long").alias("chunk_id")) if deleted is not None else given.select("chunk_id").limit(0)).distinct()
        had = self.live(self.read("docs"))
        # Only ids and hashes meet what the index holds; texts move for chunks that are new or changed.
        heads = given.groupBy("chunk_id").agg(F.min("digest").alias("digest")).join(had.select("chunk_id", "digest"), ["chunk_id", "digest"], "left_anti")
        news = small_side(stage(heads.join(gone, "chunk_id", "left_anti"), "news"))
        fresh = given.join(news, ["chunk_id", "digest"], "left_semi").dropDuplicates(["chunk_id", "digest"])
        folder = uuid.uuid4().hex
        self._write(folder, docs=_counted(fresh.select("chunk_id", "digest", self.tokenizer(F.col("text")).alias("toks"))))
        docs = self.spark.read.schema(TABLES["docs"]).parquet(f"{self.path}/{folder}/docs")
        ended = docs.select("chunk_id").unionByName(gone)
        killed = stage(had.drop("digest", "tfs").join(small_side(ended), "chunk_id", "left_semi"), "killed")
        plus, minus = docs.select(F.explode("terms").alias("term"), F.lit(1).alias("n")), killed.select(F.explode("terms").alias("term"), F.lit(-1).alias("n"))
        size = docs.select(F.lit(1).alias("d"), "dl").unionByName(killed.select(F.lit(-1).alias("d"), "dl"))
        self._write(
            folder,
            blocks=self._blocks(docs.select(self._block("chunk_id"), "chunk_id", "dl", "terms", "tfs").repartition("block")),
            change=plus.unionByName(minus).groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0"),
            killed=killed.select("chunk_id", F.col("gen").alias("of")),
            totals=size.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("d") * F.col("dl")), F.lit(0)).alias("n_tokens")),
        )
        self._commit(version + 1, [*folders, folder])

    def merge(self) -> None:
        """One generation of what lives; texts are not read again. Older folders stay for searches that began before."""
        version, folders = self._manifest()
        if len(folders) < 2:
            return
        folder = uuid.uuid4().hex
        self._write(folder, docs=self.live(self.read("docs")).drop("gen"))
        docs = self.spark.read.schema(TABLES["docs"]).parquet(f"{self.path}/{folder}/docs")
        self._write(
            folder,
            blocks=self._blocks(docs.select(self._block("chunk_id"), "chunk_id", "dl", "terms", "tfs").repartition("block")),
            change=self.frequency.withColumnRenamed("df", "n"),
            killed=self.read("killed").limit(0).drop("gen"),
            totals=self.read("totals").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")),
        )
        self._commit(version + 1, [folder])

    def _block(self, chunk_id: str) -> Column:
        return F.shiftright(chunk_id, self.bits).alias("block")

    def _blocks(self, docs: DataFrame) -> DataFrame:
        """(block, chunk_id, dl, terms, tfs), dealt by block, as postings in blocks; each file has the terms of its blocks in order."""
        ship_package(self.spark)
        rows = docs.sortWithinPartitions("block", "chunk_id").select(F.lit(0).alias("g"), "block", "chunk_id", "dl", "terms", "tfs")
        return rows.mapInArrow(_blocked(self.bits), TABLES["blocks"]).sortWithinPartitions("term", "block")

    def _opened(self, blocks: DataFrame) -> DataFrame:
        """Postings of blocks, with all other columns of these."""
        kept = [c for c in blocks.columns if c not in ("places", "tfs", "dls", "impacts")]
        row = F.explode(F.arrays_zip("places", "tfs", "dls")).alias("r")
        return blocks.select(*kept, row).select(*kept, (F.shiftleft("block", self.bits) + F.col("r.places")).alias("chunk_id"), F.col("r.tfs").alias("tf"), F.col("r.dls").alias("dl"))

    def weights(self, terms: DataFrame) -> DataFrame:
        """(query_id, term, w, avgdl) of the terms that the index knows, from (query_id, term, qf)."""
        known = self.frequency.join(small_side(terms.select("term").distinct()), "term", "left_semi")
        own = terms.join(known, "term").crossJoin(F.broadcast(self.totals))  # one row
        return stage(own.select("query_id", "term", (F.col("qf") * idf(F.col("n_docs"), F.col("df"))).alias("w"), "avgdl"), "weights")

    def bounds(self, weighted: DataFrame) -> DataFrame:
        """(query_id, gen, block, bound): no chunk of the block scores more. Postings are not read."""
        mean = F.broadcast(weighted.agg(F.max("avgdl").alias("avgdl")))  # one row
        heads = self.read("blocks").select("gen", "term", "block", "impacts").join(small_side(weighted.select("term").distinct()), "term", "left_semi").crossJoin(mean)
        best = F.array_max(F.transform("impacts", lambda i: _part(F.lit(1.0), i["tf"], i["dl"], F.col("avgdl"))))
        heads = heads.select("gen", "term", "block", best.alias("best"))  # once for a block and term, however many queries have it
        return heads.join(small_side(weighted.drop("avgdl")), "term").groupBy("query_id", "gen", "block").agg(F.sum(F.col("w") * F.col("best")).alias("bound"))

    def score(self, weighted: DataFrame, cells: DataFrame) -> DataFrame:
        """(query_id, chunk_id, bm25) of the chunks in some queries' blocks (query_id, gen, block)."""
        wanted = cells.select("query_id", "gen", "block").join(small_side(weighted), "query_id")
        found = self._opened(self.read("blocks").drop("impacts").join(wanted, ["gen", "block", "term"]))
        part = _part(F.col("w"), F.col("tf"), F.col("dl"), F.col("avgdl"))
        return self.live(found).groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("bm25"))

    def search(self, terms: DataFrame, k: int = 10, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
        """(query_id, chunk_id, bm25, rank): the best k matches of each query by score, ties by id; and its blocks with whether they were ``opened``.

        A task takes whole blocks, bounds them for all queries, and opens those that reach the k-th score it knows by
        then; it begins with ``seed`` blocks a query, and at least k. In the table ``opened`` are those that reach the k-th score
        of all, which every search must open; it is worked out where it is read, from the impacts. A query without a known
        term has no rows. Queries go in parts whose weights take at most ``WEIGHTS_MB``.
        """
        weighted = self.weights(terms)
        n, n_terms = weighted.agg(F.count_distinct("query_id"), F.count_distinct("term")).first()
        many = max(1, -(-n * n_terms * 8 // int(WEIGHTS_MB * 1e6)))
        own = F.pmod(F.xxhash64("query_id"), F.lit(many))
        with arrow_batches(self.spark, ROWS):
            tops = reduce(DataFrame.unionByName, [self._best(weighted.where(own == i), k, max(seed, k)) for i in range(many)])
        least = tops.where(F.col("rank") == k).select("query_id", F.col("bm25").alias("least"))
        reached = self.bounds(weighted).join(F.broadcast(least), "query_id", "left")  # a row a query
        may = F.col("least").isNull() | (F.col("bound") >= F.col("least") - _SLACK)
        return tops, reached.select("query_id", "gen", "block", "bound", may.alias("opened"))

    def _best(self, weighted: DataFrame, k: int, seed: int) -> DataFrame:
        """The best k matches of some queries."""
        spark, id_type = self.spark, weighted.schema["query_id"].dataType.simpleString()
        ship_package(spark)
        known = weighted.collect()  # at most WEIGHTS_MB / 8 pairs
        words, ids = sorted({r["term"] for r in known}), sorted({r["query_id"] for r in known})
        place, at = {w: i for i, w in enumerate(words)}, {q: i for i, q in enumerate(ids)}
        weights = np.zeros((len(words), len(ids)))
        for r in known:
            weights[place[r["term"]], at[r["query_id"]]] = r["w"]
        _, folders = self._manifest()
        gens = F.broadcast(spark.createDataFrame(list(enumerate(folders)), "g int, gen string"))
        numbers = F.broadcast(spark.createDataFrame(list(enumerate(words)), "t int, term string"))
        # A block's row for a term is one array; the places that later generations emptied go before as term -1.
        heads = self.read("blocks").join(numbers, "term").select("gen", "block", "t", F.concat("places", "tfs", "dls").alias("row"))
        dead = self.read("killed").select(F.col("of").alias("gen"), self._block("chunk_id"), F.col("chunk_id").bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int").alias("place"))
        dead = dead.groupBy("gen", "block").agg(F.collect_list("place").alias("p")).select("gen", "block", F.lit(-1).alias("t"), F.concat("p", "p", "p").alias("row"))
        rows = heads.unionByName(dead).join(gens, "gen").select("g", "block", "t", "row")
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        held = rows.repartition(tasks, "g", "block").sortWithinPartitions("g", "block", "t")
        model = spark.sparkContext.broadcast((weights, known[0]["avgdl"] if known else 1.0))
        names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {id_type}"))
        best = stage(held.mapInArrow(_tops(model, self.bits, k, seed), "q int, chunk_id long, bm25 double"), "best")
        return top_k(best.join(names, "q").select("query_id", "chunk_id", "bm25"), "query_id", k, [F.desc("bm25"), F.asc("chunk_id")])


class _Group:
    """Some whole blocks of a task, from rows (g, block, t, row) in order."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, mean: float, bits: int) -> None:
        g, block, t = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(len(t), bool)
        new[1:] = (g[1:] != g[:-1]) | (block[1:] != block[:-1])
        starts, of = np.flatnonzero(new), np.cumsum(new) - 1
        flat, n = batch.column(3).flatten().to_numpy(), batch.column(3).value_lengths().to_numpy().astype(np.int64)
        row, third = np.repeat(np.arange(len(n)), n // 3), np.repeat(n // 3, n // 3)
        first = np.arange(len(row)) + 2 * (np.cumsum(n // 3) - n // 3)[row]
        place, tf, dl = (flat[first + i * third].astype(np.int64) for i in range(3))
        own = of[row] << bits | place  # the chunk within the group
        live, is_dead = np.zeros(len(row), bool), t[row] < 0
        live[~is_dead] = ~np.isin(own[~is_dead], own[is_dead])
        self.weights, self.bits, self.first = weights, bits, block[starts]
        order = np.flatnonzero(live)[np.argsort(own[live], kind="stable")]
        self.chunk, self.term, self.part = own[order], t[row[order]], _part(1.0, tf[order], dl[order], mean)
        best = np.zeros(len(t))
        np.maximum.at(best, row[order], self.part)
        ends = np.append(starts, len(t))
        #: Blocks by queries: no chunk scores more.
        self.bounds = np.zeros((len(starts), weights.shape[1]))
        for i, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            a += t[a] < 0
            if z > a:
                self.bounds[i] = best[a:z] @ weights[t[a:z]]

    def scores(self, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the opened blocks' chunks: their block's place, their ids, and their scores by queries."""
        kept = opened[self.chunk >> self.bits]
        chunk, term, part = self.chunk[kept], self.term[kept], self.part[kept]
        ids, lo = np.unique(chunk, return_index=True)
        scores, ends = np.zeros((len(ids), self.weights.shape[1])), np.append(lo, len(chunk))
        for i, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            scores[i] = part[a:z] @ self.weights[term[a:z]]
        at = ids >> self.bits
        return at, (self.first[at] << self.bits) + (ids & ((1 << self.bits) - 1)), scores


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut at the ends of blocks."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g, block = (batch.column(i).to_numpy() for i in range(2))
        if rest and (rest[-1].column(0)[-1].as_py(), rest[-1].column(1)[-1].as_py()) != (g[0], block[0]):
            yield pa.concat_batches(rest)
            rest = []
        ends = np.flatnonzero((g != g[-1]) | (block != block[-1]))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield pa.concat_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.concat_batches(rest)


def _tops(model: Broadcast, bits: int, k: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query's best k chunks in a task, from the blocks whose bound reaches the k-th score so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mean = model.value
        best = [(np.zeros(0, np.int64), np.zeros(0))] * weights.shape[1]
        least = np.full(weights.shape[1], -np.inf)

        def take(group: _Group, opened: np.ndarray) -> None:
            at, ids, scores = group.scores(opened.any(1))
            matched = scores > 0
            scores = np.round(scores, 6)
            matched &= opened[at] & (scores >= least)
            for q in np.flatnonzero(matched.any(0)):
                found = np.flatnonzero(matched[:, q])
                i, s = np.concatenate([best[q][0], ids[found]]), np.concatenate([best[q][1], scores[found, q]])
                order = np.lexsort((i, -s))[:k]
                best[q] = i[order], s[order]
                if len(order) == k:
                    least[q] = s[order[-1]]

        for batch in _groups(batches):
            group = _Group(batch, weights, mean, bits)
            first = np.zeros(group.bounds.shape, bool)
            if weights.shape[1] and not np.isfinite(least).all():
                from_top = np.argsort(-group.bounds, axis=0, kind="stable")[:seed]
                np.put_along_axis(first, from_top, True, axis=0)
                take(group, first)
            take(group, (group.bounds > 0) & (group.bounds >= least - _SLACK) & ~first)
        of = np.repeat(np.arange(len(best), dtype=np.int32), [len(i) for i, _ in best])
        columns = [np.concatenate([b[c] for b in best]) if best else np.zeros(0, t) for c, t in ((0, np.int64), (1, np.float64))]
        yield pa.RecordBatch.from_arrays([pa.array(of), *map(pa.array, columns)], names=["q", "chunk_id", "bm25"])

    return run


def _blocked(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings in blocks from chunks (g, block, chunk_id, dl, terms, tfs) in order; a row holds at most 2**``bits`` chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            ids, every_dl = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            of = np.repeat(np.arange(len(ids)), batch.column(4).value_lengths().to_numpy())
            words = batch.column(4).flatten().dictionary_encode()
            term, tf = words.indices.to_numpy().astype(np.int64), batch.column(5).flatten().to_numpy()
            block, place, dl = ids[of] >> bits, ids[of] & ((1 << bits) - 1), every_dl[of]
            if not len(of):
                continue
            order = np.lexsort((place, block, term))
            block, term, place, tf, dl = (x[order] for x in (block, term, place, tf, dl))
            new = np.append(True, (block[1:] != block[:-1]) | (term[1:] != term[:-1]))
            starts, group = np.flatnonzero(new), np.cumsum(new) - 1
            ends = np.append(starts, len(block))
            best = np.lexsort((dl, tf, group))  # the shortest chunk for each count
            shortest = best[np.append(True, (group[best][1:] != group[best][:-1]) | (tf[best][1:] != tf[best][:-1]))]
            impact_ends = np.searchsorted(group[shortest], np.arange(len(starts) + 1))
            ints = lambda ends, *values: [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v.astype(np.int32))) for v in values]
            pair = pa.StructArray.from_arrays([pa.array(x[shortest].astype(np.int32)) for x in (tf, dl)], ["tf", "dl"])
            impacts = pa.ListArray.from_arrays(pa.array(impact_ends.astype(np.int32)), pair)
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term[starts])), pa.array(block[starts]), *ints(ends, place, tf, dl), impacts], names=["term", "block", "places", "tfs", "dls", "impacts"])

    return run


def _counted(texts: DataFrame) -> DataFrame:
    """(chunk_id, digest, dl, terms, tfs) from (chunk_id, digest, toks): each chunk's distinct tokens with their counts, told where the chunk lies."""
    ship_package(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            words = batch.column(2).flatten().dictionary_encode()
            many = max(len(words.dictionary), 1)
            keys, tf = np.unique(np.repeat(np.arange(batch.num_rows), n) * many + words.indices.to_numpy().astype(np.int64), return_counts=True)
            row, term = np.divmod(keys, many)
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, v) for v in (words.dictionary.take(pa.array(term)), pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int32)), *lists], names=["chunk_id", "digest", "dl", "terms", "tfs"])

    return texts.mapInArrow(count, "chunk_id long, digest string, dl int, terms array<string>, tfs array<int>")


def _part(w, tf, dl, avgdl):
    """A term's share of BM25 with the library's constants, of columns or of numbers."""
    return w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
