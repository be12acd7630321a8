"""Benchmark decontamination by a distributed positional inverted index.

Indexing stores token postings: each task turns the documents that it reads
into blocks of bounded size and writes, for each block, the positions of every
term (by a 64-bit hash) as sorted lists. The index is partitioned by document,
so postings never cross the network, and it serves any number of test sets.

A search reads the stored blocks. A test window starts from the postings of
its rarest term in the block, shifted to the window's start, and goes on
intersecting with the shifted lists of its next rarest terms. Only the test
set travels, one block of bounded size at a time.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, LARGE_ROWS, materialise, shared_dir, table

WINDOW = 10
#: Test words in one block, which a task holds (some 40 bytes each); larger test sets take several passes.
BLOCK_WORDS = 2_000_000
#: Words of training text in one block of the index, which bounds a task's memory.
INDEX_WORDS = 1_000_000
#: Contaminated ids are broadcast up to this number (16 bytes each), else joined by shuffle.
BROADCAST_IDS = 500_000
#: One row is one block: its documents, its terms in order, where each term's list begins, the positions.
INDEX = "block string, ids array<long>, keys array<long>, ends array<int>, terms array<long>, first array<int>, positions array<int>"
FOUND = "block string, at int, doc_id long, key long, n_words long, spans array<int>, items array<string>"


def term_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _arrow(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def build_index(docs: DataFrame, base: str, *, block_words: int = INDEX_WORDS) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text): every word of every text is a posting.

    A document is never split over blocks; ``key`` is a hash of its text, by
    which rows of one doc_id are told apart.
    """

    def blocks(batches):
        ids, keys, ends, codes, numbers, held = [], [], [], [], {}, 0

        def block():
            code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            terms = np.fromiter(map(term_hash, numbers), np.int64, len(numbers))
            order = np.argsort(terms, kind="stable")
            rank = np.empty(len(terms), np.int32)
            rank[order] = np.arange(len(terms), dtype=np.int32)
            code = rank[code]
            counts = np.bincount(code, minlength=len(terms))
            first = np.concatenate([[0], np.cumsum(counts)])
            return _arrow(INDEX, [[uuid.uuid4().hex], [ids], [keys], [ends], [terms[order]], [first], [np.argsort(code, kind="stable").astype(np.int32)]])

        for batch in batches:
            for i, k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or b"").translate(ALNUM).split()
                for w in words:
                    if w not in numbers:
                        numbers[w] = len(numbers)
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                held += len(words)
                ids.append(i)
                keys.append(k)
                ends.append(held)
                if held >= block_words or len(ids) >= 50_000:
                    yield block()
                    ids, keys, ends, codes, numbers, held = [], [], [], [], {}, 0
        if ids:
            yield block()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.encode("text", "UTF-8").alias("text"))
    return materialise(slim.mapInArrow(blocks, INDEX), base, f"postings-{uuid.uuid4().hex}", more=LARGE_ROWS)


class TestWindows:
    """The windows of one block of test items: term numbers in a row, and by length where windows start and whose they are.

    Equal windows are kept once. ``groups`` has (length, starts, first, owners):
    the items of window w are ``owners[first[w] : first[w + 1]]``.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        number: dict[bytes, int] = {}
        item_number: dict[str, int] = {}
        codes, ends, whose, held = [], [], [], 0
        for item, text in items:
            words = text.translate(ALNUM).split()
            if words:
                codes.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                held += len(words)
                ends.append(held)
                whose.append(item_number.setdefault(item, len(item_number)))
        self.items = list(item_number)
        self.terms = np.fromiter(map(term_hash, number), np.int64, len(number))
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        ends, whose = np.array(ends, np.int64), np.array(whose, np.int32)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        sizes = np.minimum(window, ends - begins)
        self.groups = []
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            n = ends[own] - begins[own] - size + 1
            starts = np.repeat(begins[own], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(whose[own], n)
            order = np.lexsort((owner, *(self.codes[starts + k] for k in range(size - 1, -1, -1))))
            starts, owner = starts[order], owner[order]
            new = np.ones(len(starts), bool)  # a window unlike the one before
            new[1:] = False
            for k in range(size):
                new[1:] |= self.codes[starts[1:] + k] != self.codes[starts[:-1] + k]
            other = new.copy()  # and an item unlike the one before
            other[1:] |= owner[1:] != owner[:-1]
            count = np.bincount(np.cumsum(new)[other] - 1, minlength=int(new.sum()))
            self.groups.append((size, starts[new].astype(np.int32), np.concatenate([[0], np.cumsum(count)]).astype(np.int32), owner[other]))


class Lists:
    """The shifted lists of the test terms in one stored block, as one sorted array of (term, position)."""

    def __init__(self, df: np.ndarray, positions: np.ndarray, length: int):
        self.df, self.positions, self.length = df, positions, length
        self.begin = np.cumsum(df) - df
        self.keys = np.repeat(np.arange(len(df), dtype=np.int64) * length, df) + positions

    def have(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a term's list has a position from ``low`` to ``high``."""
        base = term.astype(np.int64) * self.length
        at = np.searchsorted(self.keys, base + np.maximum(low, 0))
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (found <= base + np.minimum(high, self.length - 1))


def occurrences(lists: Lists, codes: np.ndarray, starts: np.ndarray, size: int, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of each occurrence of the windows of ``size`` terms that begin at ``starts`` in ``codes``.

    A window begins with the list of its rarest term, shifted to the window's
    start, and is intersected with the shifted lists of its other terms from
    the next rarest on. With ``slop`` every term may stand up to that many
    words from its place (proximity); 0 asks for the exact phrase.
    """
    none = np.concatenate([[0], np.cumsum(lists.df[codes] == 0)])  # terms without a list, up to each place
    live = np.flatnonzero(none[starts.astype(np.int64) + size] == none[starts])
    windows = codes[starts[live, None].astype(np.int64) + np.arange(size)]
    rank = np.argsort(lists.df[windows], axis=1, kind="stable")  # offsets by rarity
    seed = rank[:, 0]
    term = windows[np.arange(len(live)), seed]
    n = lists.df[term]
    row = np.repeat(np.arange(len(live)), n)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = lists.positions[np.repeat(lists.begin[term], n) + step].astype(np.int64) - np.repeat(seed, n)
    if slop:
        shift = np.arange(-slop, slop + 1)
        row, start = np.repeat(row, len(shift)), (start[:, None] + shift[None, :]).ravel()
    keep = (start >= 0) & (start + size <= lists.length)
    row, start = row[keep], start[keep]
    for k in range(0 if slop else 1, size):
        if not len(row):
            break
        offset = rank[row, k]
        place = start + offset
        ok = lists.have(windows[row, offset], place - slop, place + slop)
        row, start = row[ok], start[ok]
    if slop:
        row, start = np.unique(np.stack([row, start]), axis=1)
    return live[row], start


def _search_block(row: dict, tests: TestWindows, slop: int):
    """For each document of a stored block its words hit, as flat (start, end) pairs, and the items found."""
    terms, first, positions = row["terms"], row["first"], row["positions"]
    at = np.minimum(np.searchsorted(terms, tests.terms), max(0, len(terms) - 1))
    known = terms[at] == tests.terms if len(terms) else np.zeros(len(tests.terms), bool)
    begin = np.where(known, first[at], 0).astype(np.int64) if len(terms) else np.zeros(len(tests.terms), np.int64)
    df = np.where(known, first[at + 1] - first[at], 0).astype(np.int64) if len(terms) else np.zeros(len(tests.terms), np.int64)
    # positions of the whole block with a gap of the slop's width after each document
    ends = row["ends"].astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    pad = slop + 1
    inside = np.repeat(begin, df) + np.arange(int(df.sum())) - np.repeat(np.cumsum(df) - df, df)
    listed = positions[inside].astype(np.int64)
    lists = Lists(df, listed + pad * np.searchsorted(ends, listed, side="right"), int(ends[-1]) + pad * len(ends))
    new_starts = starts + pad * np.arange(len(ends))
    new_ends = ends + pad * np.arange(len(ends))
    hit = np.zeros(lists.length + 1, np.int32)
    found: dict[int, set[int]] = {}
    for size, window_starts, owner_first, owners in tests.groups:
        which, start = occurrences(lists, tests.codes, window_starts, size, slop)
        doc = np.searchsorted(new_ends, start, side="right")
        ok = start + size <= new_ends[np.minimum(doc, len(ends) - 1)]
        which, start, doc = which[ok], start[ok], doc[ok]
        np.add.at(hit, start, 1)
        np.add.at(hit, start + size, -1)
        for w, d in set(zip(which.tolist(), doc.tolist(), strict=True)):
            found.setdefault(d, set()).update(owners[owner_first[w] : owner_first[w + 1]].tolist())
    covered = np.cumsum(hit[:-1]) > 0
    for d in range(len(ends)):
        spans: list[int] = []
        if d in found:
            own = covered[new_starts[d] : new_ends[d]]
            spans = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).tolist()
        yield d, int(ends[d] - starts[d]), spans, sorted(tests.items[i] for i in found.get(d, ()))


def _blocks(benchmark: DataFrame, block_words: int):
    """Test items in blocks of bounded size; the test set comes by partitions, never whole."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.encode("text", "UTF-8").alias("text")).where("item_id is not null and text is not null")
    block, words = [], 0
    for r in rows.toLocalIterator():
        block.append((r[0], bytes(r[1])))
        words += len(r[1]) // 5 + 1
        if words >= block_words:
            yield block
            block, words = [], 0
    yield block


def _searched(index: DataFrame, tests, slop: int) -> DataFrame:
    def search(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name: batch.column(name)[k].values.to_numpy(zero_copy_only=False)  # noqa: B023,E731
                row = {name: get(name) for name in ("ends", "terms", "first", "positions")}
                ids, keys = batch.column("ids")[k].as_py(), batch.column("keys")[k].as_py()
                name = batch.column("block")[k].as_py()
                out = [(name, d, ids[d], keys[d], n, spans, items) for d, n, spans, items in _search_block(row, tests.value, slop)]
                for i in range(0, len(out), 5000):
                    yield _arrow(FOUND, list(zip(*out[i : i + 5000], strict=True)))

    return index.mapInArrow(search, FOUND)


def search_index(index: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, key, n_words, n_hit, spans, items) for every indexed row.

    A window is ``window`` consecutive words of an item (all of them if the
    item has fewer); a word inside an occurrence of a window is hit. ``spans``
    has the words hit as (start, end) pairs, ``items`` the sorted ids of the
    items found. With ``slop`` over 0 every word of a window may stand that far
    from its place. Null texts have no words; items that are null or have no
    words are never found; rows of one item_id count as one item. Repeated
    rows stay repeated.
    """
    spark = index.sparkSession
    base, parts, last = shared_dir(spark), [], None
    for block in _blocks(benchmark, block_words):
        if last is not None:  # one block of tests at a time: what came before is written, and its broadcast goes
            parts.append(materialise(_searched(index, last, slop), base, f"found-{len(parts)}"))
            last.unpersist()
        last = spark.sparkContext.broadcast(TestWindows(block, window))
    out = _searched(index, last, slop)
    if parts:  # spans of several blocks of tests overlap: join them
        for p in parts:
            out = out.unionByName(p)
        out = out.groupBy("block", "at").agg(
            F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("flat"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        pairs = F.array_sort(F.filter(F.transform("flat", lambda x, i: F.when(i % 2 == 0, F.struct(x.alias("a"), F.get("flat", i + 1).alias("b")))), lambda x: x.isNotNull()))

        def join(s, x):
            more = (F.size(s) > 0) & (F.element_at(s, -1) >= x["a"])
            return F.when(more, F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.greatest(F.element_at(s, -1), x["b"])))).otherwise(F.concat(s, F.array(x["a"], x["b"])))

        out = out.withColumn("spans", F.when(F.size("flat") > 0, F.aggregate(pairs, F.array().cast("array<int>"), join)).otherwise(F.array().cast("array<int>")))
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda s, x: s + x)
    return out.select("doc_id", "key", "n_words", n_hit.cast("long").alias("n_hit"), "spans", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` in which no test window occurs, with their own columns."""
    base = shared_dir(docs.sparkSession)
    found = search_index(build_index(docs, base), benchmark, **kw)
    gone = materialise(found.where("n_hit > 0").select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct(), base, "contaminated")
    small = gone.count() <= BROADCAST_IDS
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_key"])
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti")


def op4(spark, sf_dir: str) -> DataFrame:
    """Words hit and items found for each row of ``documents``, held against all of ``benchmark``."""
    index = build_index(table(spark, sf_dir, "documents"), shared_dir(spark))
    return search_index(index, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


__all__ = ["BLOCK_WORDS", "WINDOW", "TestWindows", "build_index", "drop_contaminated", "search_index"]

OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, list_slice(w, i, i + least(10, len(w)) - 1) AS g
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, i, ks.k, list_slice(w, i, i + ks.k - 1) AS g
  FROM d, ks, unnest(range(1, len(w) - ks.k + 2)) AS t(i) WHERE len(w) >= ks.k),
m AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
