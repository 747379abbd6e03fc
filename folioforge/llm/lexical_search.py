"""Ranked lexical search: document-at-a-time over compressed postings of document shards.

The index is a table.  A task cuts its documents into shards of bounded text; a
shard has one row per term with its postings, sorted by doc_id and compressed
(distances of the documents' places in the shard and term frequencies, seven bits
a byte), and one directory row without a term that holds ids and lengths.  No
posting is shuffled to build it.

A search takes the wanted terms' rows, sums their document frequencies, and
brings each shard's rows together.  There every item's lists are merged by a heap
of their next documents, and a heap of the best results is kept, worst of them on
top, by score and then doc_id.  Documents come in ascending order, so a later one
has to score higher than the worst of a full heap.  Lists whose greatest
contributions together cannot reach that leave the merge; they are only looked up
for documents that the others bring.  This drops no result.  The results of all
shards are merged by a window over each item.

Defined results: a text that is null or without terms counts as no document; an
item without terms or without any hit has no rows; rows of one item_id, null
included, are one item with the terms of all its texts; documents stay separate
whatever their doc_id, a null doc_id is placed after all others of its score;
equal scores are ranked by ascending doc_id; empty tables give empty tables;
extra columns don't matter.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import ENCODE_BYTES, as_texts
from .common import bounded_batches, materialize, named, text_bytes

#: Text of one shard; a longer document is a shard of its own.
SHARD_BYTES = 24 << 20
#: Item-term pairs of one pass over the index, and the bytes of their terms that are broadcast at most.
PASS_ROWS, PASS_BYTES = 500_000, 16 << 20
TOP = 10
K1, B, SCALE = 8, 90, 1000  # fixed values of the score: 0.8, 0.9 and the weights' scale, as integers
#: ASCII characters that are no letters or digits separate terms; only A-Z are lower-cased.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Non-negative integers in seven bits a byte, low bits first, and the bytes of each."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 9):
        sizes += values >= 1 << 7 * k
    at, out = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = sizes > k
        out[at[some] + k] = (values[some] >> 7 * k) & 127 | (sizes[some] > k + 1) * 128
    return out.tobytes(), sizes


def unpack(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(part < 128)
    if not len(ends):
        return np.empty(0, np.int64)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(part)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((part.astype(np.int64) & 127) << 7 * place, starts)


def terms_of(raws: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(terms of all texts in order, first term of each text)."""
    texts = as_texts(raws)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = (texts.buffers()[2].to_pybytes() if texts.buffers()[2] else b"").translate(TERM_BYTES)
    spaced = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
    split = pc.split_pattern(spaced, " ")
    borders = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(borders[0], borders[-1] - borders[0])
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    return flat.filter(full).dictionary_encode(), before[borders - borders[0]]


class Shard:
    """Collects documents until there is enough text for one shard."""

    def __init__(self):
        self.parts, self.bytes = [], 0

    def add(self, ids: pa.Array, raws: pa.Array) -> None:
        coded, starts = terms_of(raws)
        n, v = len(raws), max(len(coded.dictionary), 1)
        owner = np.repeat(np.arange(n), np.diff(starts))
        key, tf = np.unique(owner * v + coded.indices.to_numpy(), return_counts=True)
        self.parts.append((ids, np.diff(starts), key // v, key % v, tf, coded.dictionary))
        self.bytes += raws.nbytes

    def rows(self, shard: int):
        """The shard's record batches."""
        ids = pa.concat_arrays([p[0].cast(pa.int64()) for p in self.parts])
        lengths = np.concatenate([p[1] for p in self.parts])
        base = np.cumsum([0, *(len(p[1]) for p in self.parts)])
        coded = pa.concat_arrays([p[5] for p in self.parts]).dictionary_encode()
        code, shift = coded.indices.to_numpy(), np.cumsum([0, *(len(p[5]) for p in self.parts)])
        doc = np.concatenate([p[2] + b for p, b in zip(self.parts, base)])
        term = np.concatenate([code[p[3] + s] for p, s in zip(self.parts, shift)]).astype(np.int64)
        tf = np.concatenate([p[4] for p in self.parts])
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        order = order[lengths[order] > 0]  # documents without terms don't count
        place = np.empty(len(lengths), np.int64)
        place[order] = np.arange(len(order))
        by = np.lexsort((place[doc], term))
        doc, term, tf = place[doc][by], term[by], tf[by]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        gaps = np.diff(doc, prepend=0)
        gaps[first] = doc[first]
        data, sizes = pack(np.column_stack([gaps, tf]).ravel())
        ends = np.append(0, np.cumsum(sizes))
        counts = np.diff(np.append(first, len(term)))
        postings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends[2 * np.append(first, len(term))].tobytes()), pa.py_buffer(data)])
        words = coded.dictionary.take(pa.array(term[first]))
        for k in range(0, len(first), 20_000):
            n = len(words.slice(k, 20_000))
            yield _rows([shard] * n, words.slice(k, n), counts[k : k + n], [0] * n, postings.slice(k, n), None)
        if len(order):
            # in the directory row: lengths, packed, and ids as they are
            sides = [pa.array([x], pa.large_binary()) for x in (pack(lengths[order])[0], np.asarray(ids.fill_null(0))[order].tobytes())]
            blanks = int(pc.sum(pc.is_null(ids.take(pa.array(order)))).as_py() or 0)
            yield _rows([shard], pa.array([None], pa.large_string()), np.array([len(order)]), [int(lengths.sum())], *sides, blanks)


NAMES = ["shard", "term", "df", "terms", "postings", "ids", "blanks"]
INDEX = "shard long, term string, df long, terms long, postings binary, ids binary, blanks int"


def _rows(shard, term, df, terms, postings, ids=None, blanks=None) -> pa.RecordBatch:
    n = len(shard)
    sides = [ids.cast(pa.binary()) if ids is not None else pa.nulls(n, pa.binary()), pa.array([blanks] * n, pa.int32())]
    columns = [pa.array(shard, pa.int64()), term.cast(pa.string()), pa.array(df, pa.int64()), pa.array(terms, pa.int64()), postings.cast(pa.binary()), *sides]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def index_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index: a row per shard and term (df: its documents there) and a directory row per shard (df: documents, terms: their terms)."""

    def run(batches):
        shard, made = Shard(), 0
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            shard.add(batch.column(0), batch.column(1))
            if shard.bytes >= shard_bytes:
                yield from shard.rows(task + made)
                shard, made = Shard(), made + 1
        if shard.parts:
            yield from shard.rows(task + made)

    return bounded_batches(docs, ENCODE_BYTES).select(named(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("raw")).mapInArrow(run, INDEX)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item_id, term)."""

    def run(batches):
        for batch in batches:
            coded, starts = terms_of(batch.column(1))
            owner = np.repeat(np.arange(len(batch)), np.diff(starts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), coded.cast(pa.large_string()).cast(pa.string())], ["item_id", "term"])

    rows = bounded_batches(items, ENCODE_BYTES).select(named(item_id).alias("item_id"), text_bytes(text).alias("raw"))
    kind = items.schema[item_id].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, term string").distinct()


def best_documents(lists: list[tuple[array, array, int]], top: int) -> list[tuple[int, int]]:
    """(score, place) of the ``top`` places with the highest sums over ``lists`` of (places, contributions, greatest one).

    Ties go to the lower place.
    """
    lists = sorted((x for x in lists if x[2] > 0), key=lambda x: x[2])
    reach, total = [], 0  # what the lists up to one can give together
    for _, _, most in lists:
        total += most
        reach.append(total)
    at = [0] * len(lists)
    merge = [(places[0], k) for k, (places, _, _) in enumerate(lists)]
    heapq.heapify(merge)
    best: list[tuple[int, int]] = []  # (score, -place), worst on top
    idle, floor = 0, 0  # lists before ``idle`` are not in the merge
    while merge:
        place, score = merge[0][0], 0
        while merge and merge[0][0] == place:
            k = merge[0][1]
            places, gains, _ = lists[k]
            i = at[k]
            score += gains[i]
            at[k] = i = i + 1
            if i < len(places) and k >= idle:
                heapq.heapreplace(merge, (places[i], k))
            else:
                heapq.heappop(merge)
        k = idle - 1
        while k >= 0 and score + reach[k] > floor:
            places, gains, _ = lists[k]
            at[k] = i = bisect_left(places, place, at[k])
            if i < len(places) and places[i] == place:
                score += gains[i]
            k -= 1
        if score > floor and k < 0:
            if len(best) < top:
                heapq.heappush(best, (score, -place))
            else:
                heapq.heapreplace(best, (score, -place))
            if len(best) == top and best[0][0] > floor:
                floor, was = best[0][0], idle
                while idle < len(lists) and reach[idle] <= floor:
                    idle += 1
                if idle > was:
                    merge = [x for x in merge if x[1] >= idle]
                    heapq.heapify(merge)
    return [(s, -p) for s, p in best]


def _search_shard(table: pa.Table, items: list[tuple[object, list[str]]], n_docs: int, n_terms: int, top: int):
    """(items' numbers, doc_ids, scores) of one shard's best documents."""
    words, weights = table.column("term").to_pylist(), table.column("w").to_pylist()
    here = words.index(None)
    lengths = unpack(table.column("postings")[here].as_py())
    ids = np.frombuffer(table.column("ids")[here].as_py(), np.int64).tolist()
    known = len(ids) - table.column("blanks")[here].as_py()
    base = 100 - B + (B * lengths * n_docs) // n_terms
    lists = {}
    for k, (word, w) in enumerate(zip(words, weights)):
        if word is not None and w > 0:
            pairs = unpack(table.column("postings")[k].as_py()).reshape(-1, 2)
            places, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
            gains = w * ((1_000_000_000 * tf) // (SCALE * tf + K1 * base[places]))
            lists[word] = (array("q", places.tobytes()), array("q", gains.tobytes()), int(gains.max()))
    out: tuple[list, list, list] = ([], [], [])
    for number, (_, terms) in enumerate(items):
        for score, place in best_documents([lists[t] for t in terms if t in lists], top):
            out[0].append(number)
            out[1].append(ids[place] if place < known else None)
            out[2].append(score)
    return out


def search(index: DataFrame, wanted: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``top`` best documents, for ``wanted(item_id, term)`` distinct.

    ``index`` should be a written table, for it is read twice a pass; items are dealt by
    their ids on passes of about PASS_ROWS pairs each.
    """
    spark = index.sparkSession
    facts = index.where("term IS NULL").agg(F.sum("df"), F.sum("terms")).first()
    n_docs, n_terms = facts[0] or 0, facts[1] or 0
    total = wanted.count()
    passes = max(1, -(-total // PASS_ROWS))
    kind = wanted.schema["item_id"].dataType.simpleString()
    parts = [_one_pass(index, wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k), n_docs, n_terms, top, kind) for k in range(passes)]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    if not n_docs or not total:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _one_pass(index: DataFrame, wanted: DataFrame, n_docs: int, n_terms: int, top: int, kind: str) -> DataFrame:
    spark = index.sparkSession
    rows = wanted.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).toArrow()
    items = list(zip(rows.column("item_id").to_pylist(), rows.column("terms").to_pylist()))
    sent = spark.sparkContext.broadcast(items)
    terms = wanted.select("term").distinct()
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0]
    lists = index.where("term IS NOT NULL").join(F.broadcast(terms) if size <= PASS_BYTES else terms, "term", "left_semi")
    w = F.floor(SCALE * F.log((2 * F.lit(n_docs) + 2) / (2 * F.sum("df") + 1))).alias("w")
    weights = lists.groupBy("term").agg(w)
    weighed = lists.join(F.broadcast(weights) if size <= PASS_BYTES else weights, "term")
    names = ["shard", "term", "postings", "ids", "blanks", "w"]
    every = weighed.select(*names).union(index.where("term IS NULL").withColumn("w", F.lit(0).cast("long")).select(*names))

    def run(table: pa.Table) -> pa.Table:
        number, ids, scores = _search_shard(table, sent.value, n_docs, n_terms, top)
        item_ids = pa.array([i for i, _ in sent.value], id_type).take(pa.array(number, pa.int64()))
        return pa.table({"item_id": item_ids, "doc_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    id_type = rows.schema.field("item_id").type
    return every.groupBy("shard").applyInArrow(run, f"item_id {kind}, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the ``top`` documents of the highest score above 0."""
    index = materialize(index_documents(docs, doc_id, text), "postings")
    return search(index, materialize(item_terms(items, item_id, item_text), "item-terms"), top)
