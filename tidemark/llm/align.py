"""Cross-tokenizer alignment, relational: where two tokenizers cut the same bytes.

Tokens are exploded with their position, cumulative lengths give their ends,
the two sides meet on (segment, end), running counts of the ends that both
have are the group ids, and the tokens that cover the bytes up to each end are
the links.

The unit that is encoded is not the document but the segment: a text is split
before every single space that stands between two characters which are no
white space. There both tokenizers always cut, whatever stands around: the
byte-level one starts a new word before matching such a space, and the other's
vocabulary has no piece with a space after another character
(:func:`_piece_sizes` refuses one that has), so nothing can be merged across.
Tokens of a document are those of its segments, in order. So each different
segment is encoded and aligned once, however often it occurs; counts over the
corpus weigh it by its occurrences. Texts without spaces are one segment.

Steps: documents are cut into chunks of a bounded number of characters; a
chunk lists its different segments and, for each document, their places
(:func:`_split`). Segments of all chunks are counted, encoded and aligned. What
a document needs of its segments comes back once for each chunk and segment,
not once for each occurrence, and is added up chunk by chunk (:func:`_gather`).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, lean_shuffles, materialise, shared_dir, table

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of the texts of one chunk, beyond which a new one begins: bounds the segments that a worker holds at once.
CHUNK_CHARS = 32_000_000
#: What counts as white space here: more than either tokenizer does, so a cut is never made in doubt.
WHITE = r"\s\u180e\u200b\ufeff"
CUT = re.compile(rf"(?<=[^{WHITE}]) (?=[^{WHITE}])")
#: White space but for the space itself.
OTHER_WHITE = re.compile(r"[^\S ]|[\u180e\u200b\ufeff]")
SPACE_MARK = "\u2581"
#: Segments of a chunk, beyond which a new one begins: a worker holds 150 to 200 bytes for each.
MOST_PLACES = 1_000_000
#: A segment's key is its chunk, then its place, in one number, which sorts fast; a chunk's documents have the last place.
PLACE_BITS, CHUNK_BITS = 28, 12
LAST_PLACE = (1 << PLACE_BITS) - 1
#: Segments in one output batch, and their characters (16 MB at most) but for a single longer one.
ROWS, BATCH_CHARS = 20_000, 1 << 22
#: Characters that are encoded at once, but for a single longer segment: without spaces each takes up to 240 bytes meanwhile.
ENCODE_CHARS = 1 << 18
#: Parts in which segments are aligned one after the other: bounds the shuffle files that are there at once.
SLICES = 4

COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _local(path: str) -> str:
    """The file itself, or the copy that ``SparkContext.addFile`` has sent along."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=2)
def _byte_level(path: str):
    """Tokenizer and bytes of each of its entries: the byte-level alphabet has one character for each byte."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = Tokenizer.from_file(_local(path))
    encoder.encode_special_tokens = True
    names = (encoder.id_to_token(i) for i in range(encoder.get_vocab_size()))
    return encoder, np.array([len(x or "") for x in names], np.int32)


def _piece_sizes(pieces: list[str], is_byte: list[bool]) -> np.ndarray:
    """Bytes of each piece. A space after another character would let merges cross a cut."""
    if crossing := [p for p in pieces if re.search(rf"[^{SPACE_MARK}]{SPACE_MARK}", p)]:
        raise ValueError(f"pieces with a space inside: {crossing[:5]}")
    return np.array([1 if b else len(p.replace(SPACE_MARK, " ").encode()) for p, b in zip(pieces, is_byte, strict=True)], np.int32)


@lru_cache(maxsize=2)
def _pieces(path: str):
    from sentencepiece import SentencePieceProcessor

    encoder = SentencePieceProcessor(model_file=_local(path))
    ids = range(encoder.get_piece_size())
    return encoder, _piece_sizes([encoder.id_to_piece(i) for i in ids], [encoder.is_byte(i) for i in ids])


def segments(text: str) -> list[str]:
    """``text`` split at its cuts, without the space of each cut."""
    odd = "  " in text or text[:1] == " " or text[-1:] == " "
    # Most texts have no other space than cuts, and are split faster at all of them.
    odd = odd or any(" " in text[max(m.start() - 1, 0) : m.end() + 1] for m in OTHER_WHITE.finditer(text))
    return CUT.split(text) if odd else text.split(" ")


def _kept_whole(text: str, encoder) -> bool:
    """Whether the pieces of ``text`` spell a space and ``text``: nothing normalised, and no mark that would decode as a space."""
    return SPACE_MARK not in text and encoder.normalize(text) == SPACE_MARK + text.replace(" ", SPACE_MARK)


def _parts(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Bounds of parts of ``texts`` with at most ``ROWS`` texts and ``chars`` characters, but for single longer texts."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    lo = 0
    while lo < len(texts):
        fits = int(np.searchsorted(ends, chars + (ends[lo - 1] if lo else 0), "right"))
        hi = max(lo + 1, min(lo + ROWS, fits))
        yield lo, hi
        lo = hi


CHUNK_SCHEMA = "key long, segment string, n long, doc_id long, places binary"


def _planes(places: np.ndarray) -> bytes:
    """Places as 32-bit numbers: all low halves first, then the high ones, which compress to little."""
    return places.astype("<u2").tobytes() + (places >> 16).astype("<u2").tobytes()


def _places(raw: bytes) -> np.ndarray:
    size = len(raw) // 4
    return np.frombuffer(raw, "<u2", size).astype(np.int64) + (np.frombuffer(raw, "<u2", size, 2 * size).astype(np.int64) << 16)


def _split(path_b: str, chunk_chars: int):
    """Worker: rows of documents (doc_id, places of their segments) and, for each chunk, of its different segments with their number."""
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]

    def batch(chunk: int, place, size: int, **columns) -> pa.RecordBatch:
        kinds = {"segment": pa.string(), "n": pa.int64(), "doc_id": pa.int64(), "places": pa.binary()}
        arrays = [pa.array(np.full(size, chunk << PLACE_BITS, np.int64) + place)]
        arrays += [pa.array(columns[k], kinds[k]) if k in columns else pa.nulls(size, kinds[k]) for k in names[1:]]
        return pa.RecordBatch.from_arrays(arrays, names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _pieces(path_b)
        chunk = TaskContext.get().partitionId() << CHUNK_BITS
        end = chunk + (1 << CHUNK_BITS)
        place: dict[str, int] = {}
        used: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(place)
            counts = np.bincount(np.concatenate(used), minlength=len(found)) if used else np.zeros(0, np.int64)
            for lo, hi in _parts(found, BATCH_CHARS):
                yield batch(chunk, np.arange(lo, hi), hi - lo, segment=found[lo:hi], n=counts[lo:hi])

        for rows in batches:
            ids, places = [], []

            def documents() -> Iterator[pa.RecordBatch]:
                if ids:
                    yield batch(chunk, LAST_PLACE, len(ids), doc_id=ids, places=places)

            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                known, own = len(place), np.empty(0, np.int32)
                if text:
                    own = np.array([place.setdefault(x, len(place)) for x in segments(text)], np.int32)
                    # Segments that the chunk has are spelt; a text is as well if those that it adds are.
                    new = list(islice(reversed(place), len(place) - known))
                    if new and not _kept_whole(" ".join(new), encoder):
                        for x in new:
                            del place[x]
                        own = own[:0]
                    used.append(own)
                    size += len(text)
                ids.append(doc_id)
                places.append(_planes(own))
                if size >= chunk_chars or len(place) >= MOST_PLACES:
                    yield from documents()
                    yield from flush()
                    ids, places = [], []
                    chunk, size = chunk + 1, 0
                    if chunk == end:
                        raise ValueError(f"over {1 << CHUNK_BITS} chunks in one partition: read the texts in smaller ones")
                    place.clear()
                    used.clear()
            yield from documents()
        yield from flush()

    return work


TOKEN_SCHEMA = "w long, segment string, n long, a array<int>, a_size array<int>, b array<int>, b_size array<int>"


def _encode(path_a: str, path_b: str):
    """Worker: ids and byte lengths of each segment by both tokenizers, and a number for the segment."""

    def lists(ids: list[list[int]], sizes: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.fromiter((i for x in ids for i in x), np.int32, offsets[-1])
        ends = np.concatenate([[0], np.cumsum(sizes[flat], dtype=np.int64)])
        return pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, sizes[flat]), np.diff(ends[offsets])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, first_sizes), (second, second_sizes) = _byte_level(path_a), _pieces(path_b)
        number = TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in TOKEN_SCHEMA.split(", ")]
        for rows, texts in ((x.slice(lo, hi - lo), own[lo:hi]) for x in batches for own in [x.column(0).to_pylist()] for lo, hi in _parts(own, ENCODE_CHARS)):
            a, a_size, a_bytes = lists([x.ids for x in first.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)], first_sizes)
            b, b_size, b_bytes = lists(second.encode(texts, num_threads=1), second_sizes)
            whole = np.array([1 + len(x.encode()) for x in texts])
            if not ((a_bytes == whole).all() and (b_bytes == whole).all()):
                raise ValueError("tokens don't spell their segment")
            w = pa.array(np.arange(number, number + len(texts), dtype=np.int64))
            number += len(texts)
            yield pa.RecordBatch.from_arrays([w, rows.column(0).cast(pa.string()), rows.column(1), a, a_size, b, b_size], names)

    return work


def token_ends(tokens: DataFrame, side: str) -> DataFrame:
    """(w, end, id as ``side``): one row for each token of one tokenizer, with the byte that it ends at."""
    dealt = tokens.select("w", side, f"{side}_size").repartition("w")
    rows = dealt.select("w", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_size").alias("size"))).alias("pos", "token"))
    so_far = Window.partitionBy("w").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("w", F.sum("token.size").over(so_far).alias("end"), F.col("token.id").alias(side))


def align_segments(tokens: DataFrame) -> DataFrame:
    """For each w of ``tokens``: ``groups`` as text, n_a, n_b, n_groups, and ``links`` as an array of (a, b).

    Rows of both sides meet on (w, end). From the end of a segment backwards,
    the number of ends that both have is the group; and the last token seen of
    either side is the one that covers the bytes up to an end. Between two
    neighbouring ends one token of each side covers all bytes, and at an end one
    of the two changes: so each end makes one link, and a group without inner
    cuts costs its ends and not the product of its sides.
    """
    both = token_ends(tokens, "a").join(token_ends(tokens, "b"), ["w", "end"], "full")
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    back = Window.partitionBy("w").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.select(
        "w", "end", (-F.sum(cut.cast("int")).over(back)).alias("group"), "a", "b",
        F.last("a", True).over(back).alias("over_a"), F.last("b", True).over(back).alias("over_b"),
    )
    ends = rows.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("group", "end", "a", "b", "over_a", "over_b"))).alias("ends"))
    # One walk over a segment's ends: tokens of both sides are written down until the group changes.
    more = lambda text, x: F.when(x.isNull(), text).when(text == "", x.cast("string")).otherwise(F.concat(text, F.lit(","), x.cast("string")))
    closed = lambda s: F.when(s["a"] == "", s["text"]).otherwise(F.concat(s["text"], F.when(s["text"] == "", "").otherwise(F.lit(";")), s["a"], F.lit("|"), s["b"]))
    state = lambda group, text, a, b: F.struct(group.alias("group"), text.alias("text"), a.alias("a"), b.alias("b"))
    none = F.lit("")

    def step(s, x):
        return F.when(s["group"] == x["group"], state(x["group"], s["text"], more(s["a"], x["a"]), more(s["b"], x["b"]))).otherwise(
            state(x["group"], closed(s), more(none, x["a"]), more(none, x["b"])))

    count = lambda c: F.size(F.filter("ends", lambda x: x[c].isNotNull())).cast("long")
    return ends.select(
        "w", F.aggregate("ends", state(F.lit(1).cast("long"), none, none, none), step, closed).alias("groups"),
        count("a").alias("n_a"), count("b").alias("n_b"), (-F.col("ends")[0]["group"]).alias("n_groups"),
        F.transform("ends", lambda x: F.struct(x["over_a"].alias("a"), x["over_b"].alias("b"))).alias("links"),
    )


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links of all documents hold a pair, and whether no pair of its b has more.

    The pairs of one b are at most the entries of the other vocabulary.
    """
    pairs = aligned.select("n", F.explode("links").alias("link")).groupBy("link.a", "link.b").agg(F.sum("n").alias("count"))
    return pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def _gather(digest: bool):
    """Worker over rows by key: a chunk's segments come first, in order of place, then its documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, texts, blocks, sums = None, [], [], None
        for rows in batches:
            keys = rows.column(0).to_numpy(zero_copy_only=False)
            chunks, documents = keys >> PLACE_BITS, (keys & LAST_PLACE) == LAST_PLACE
            edges = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(documents.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(chunks)], strict=True):
                if lo == hi:
                    continue
                if chunks[lo] != chunk:
                    chunk, texts, blocks, sums = chunks[lo], [], [], None
                part = rows.slice(lo, hi - lo)
                if not documents[lo]:
                    texts += part.column(1).to_pylist()
                    blocks.append(np.stack([part.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))], axis=1).astype(np.int64))
                    continue
                if sums is None:
                    sums = np.concatenate(blocks) if blocks else np.zeros((0, len(COUNTS)), np.int64)
                total, out = np.zeros((hi - lo, len(COUNTS)), np.int64), []
                for i, raw in enumerate(part.column(len(COUNTS) + 3).to_pylist()):
                    own = _places(raw)
                    total[i] = sums[own].sum(axis=0)
                    joined = b";".join([texts[j] for j in own.tolist()])
                    out.append(hashlib.sha256(joined).hexdigest() if digest and joined else joined.decode())
                arrays = [part.column(len(COUNTS) + 2), *(pa.array(total[:, i]) for i in range(len(COUNTS))), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *COUNTS, "groups"])

    return work


def align(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, digest: bool = False, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Two tokenizers' tokens of each text of ``docs`` (doc_id, text), side by side.

    One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum and ``groups``: token ids as ``a1,a2|b1;a3|b2,b3`` (with
    ``digest`` their SHA-256 in lower-case hex). Both encode a space and the
    text, without special tokens. A link is a pair of tokens whose bytes
    overlap; its count is that of its pair of ids over all documents.

    Null and empty texts, and texts that the second tokenizer doesn't spell
    byte for byte (those with U+2581), have zeros and an empty ``groups``, and
    add nothing to counts. Repeated rows are encoded once and counted as often
    as they stand there; null ids stay null. Texts of any length are whole;
    one without spaces is one segment, whose tokens are sorted in one task.
    Other columns of ``docs``, whatever their names, are not read. The two
    tokenizer files must lie at their path on every executor, or be sent with
    ``SparkContext.addFile``.
    """
    spark = docs.sparkSession
    base = shared_dir(spark)
    with lean_shuffles(spark):
        slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        chunks = materialise(slim.mapInArrow(_split(tokenizer_b, chunk_chars), CHUNK_SCHEMA), base, "chunks", "zstd")
        places = chunks.where("segment is not null")
        different = places.groupBy("segment").agg(F.sum("n").alias("n"))
        tokens = materialise(different.mapInArrow(_encode(tokenizer_a, tokenizer_b), TOKEN_SCHEMA), base, "tokens")
        for i in range(SLICES):
            part = tokens.where(F.pmod(F.xxhash64("w"), F.lit(SLICES)) == i)
            own = align_segments(part).join(part.select("w", "segment", "n"), "w")
            with lean_shuffles(spark, together=True):
                materialise(own, base, f"aligned/part={i}")
        aligned = spark.read.schema(own.schema).parquet(f"{base}/aligned/part=*")
        discard(spark, f"{base}/tokens")
        links = aligned.select("w", F.explode("links").alias("link")).select("w", "link.a", "link.b")
        sums = links.join(link_counts(aligned), ["a", "b"]).groupBy("w").agg(
            F.count("*").alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum")
        )
        per_segment = materialise(aligned.drop("links", "n").join(sums, "w").drop("w"), base, "segments")
        discard(spark, f"{base}/aligned")
        known = materialise(places.select("key", "segment").join(per_segment, "segment").select("key", "groups", *COUNTS), base, "known", "zstd")
        discard(spark, f"{base}/segments")
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    documents = chunks.where("places is not null").select("key", nothing("binary", "groups"), *(nothing("long", c) for c in COUNTS), "doc_id", "places")
    segments_known = known.select("key", F.col("groups").cast("binary").alias("groups"), *COUNTS, nothing("long", "doc_id"), nothing("binary", "places"))
    dealt = segments_known.unionByName(documents).repartition(F.shiftright("key", PLACE_BITS)).sortWithinPartitions("key")
    return dealt.mapInArrow(_gather(digest), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups string")


def op13(spark, sf_dir: str) -> DataFrame:
    """Alignment of the texts of all ``documents``."""
    return align(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
