"""Byte-pair encoding over a table of distinct words, and decoding over an id-to-piece table.

A text is split into the words that merges never cross. Every distinct word of the corpus is encoded once; its ids come back to
the positions it stood at. Words that are frequent in a sample of the documents, a bounded number that makes up most positions,
come back by broadcast and are never shuffled; all others meet at the word, where one encoding serves all their positions, and then
at the document. Which words the sample holds decides only on which way they take.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.llm.scratch import Scratch

#: Words that are broadcast at most, their bytes at most, and the documents, by expectation, from which they are chosen.
HEAD_WORDS, HEAD_BYTES, HEAD_DOCUMENTS = 1_000_000, 16 << 20, 50_000
#: Documents of a batch at most, as whole texts pass through it as lists of words.
BATCH_ROWS = 500
#: Words of more bytes are never broadcast, and their positions are spread over so many tasks.
LONG_BYTES, LONG_SPREAD = 256, 64
#: Rows and ids after which finished documents are passed on.
OUT_ROWS, OUT_IDS = 500, 1_000_000
#: The pre-tokenizer's pattern for byte-level vocabularies, a fixed value; (?U) gives the classes their Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_HOLE = 0


class Vocabulary:
    """A tokenizer file, opened where it is used; its text (a few MB) travels with the task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.text = file.read()
        spec = json.loads(self.text)
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}

    def open(self):
        # Spark runs as many tasks as there are cores; threads of each would only cost memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def pieces(self) -> dict[int, bytes]:
        """The bytes of each id; the vocabulary writes a byte as a printable character."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [byte for byte in range(256) if byte not in set(printable)]
        byte_of = {chr(byte): byte for byte in printable} | {chr(256 + n): byte for n, byte in enumerate(others)}
        spec = json.loads(self.text)
        table = {number: bytes(byte_of[c] for c in piece) for piece, number in spec["model"]["vocab"].items()}
        return table | {number: content.encode() for content, number in self.special.items()}

    def piece_list(self) -> list[bytes]:
        """The pieces by id; ids that the vocabulary leaves out are empty."""
        table = self.pieces()
        return [table.get(number, b"") for number in range(max(table) + 1)]


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def words_of(text: Column, special: list[str]) -> Column:
    """The words of a text in order; joined they are the text. A special token stands alone."""
    def split(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(PATTERN), F.lit(0))

    if not special:
        return split(text)
    either = "|".join(_quoted(s) for s in sorted(special, key=len, reverse=True))
    parts, marks = F.split(text, either, -1), F.regexp_extract_all(text, F.lit(either), F.lit(0))
    several = F.flatten(F.transform(parts, lambda part, at: F.concat(split(part), F.when(at < F.size(marks), F.array(F.get(marks, at))).otherwise(F.array().cast("array<string>")))))
    return F.when(text.rlike(either), several).otherwise(split(text))


def _around(text: str, mark: str) -> list[str]:
    parts = []
    for part in text.split(mark):
        parts += [part, mark]
    return [p for p in parts[:-1] if p]


def _word_lists(vocabulary: Vocabulary, batches):
    """(batch, word lists) as Arrow data; texts with characters that the JVM does not know are split by the tokenizer itself."""
    splitter = None
    for batch in batches:
        words = batch.column("words")
        if batch.column("unknown").null_count < batch.num_rows:
            rows = words.to_pylist()
            splitter = splitter or vocabulary.open().pre_tokenizer
            for row, text in enumerate(batch.column("unknown").to_pylist()):
                if text is not None:
                    parts = [text]
                    for special in sorted(vocabulary.special, key=len, reverse=True):
                        parts = [q for p in parts for q in ([p] if p in vocabulary.special else _around(p, special))]
                    rows[row] = [w for p in parts for w in ([p] if p in vocabulary.special else [p[a:b] for _, (a, b) in splitter.pre_tokenize_str(p)])]
            words = pa.array(rows, pa.list_(pa.string()))
        yield batch, words
    pa.default_memory_pool().release_unused()  # the worker lives on


def _sample_words(vocabulary):
    """Words of the sampled documents and how often they occur, counted by batch."""
    def run(batches):
        for _, words in _word_lists(vocabulary, batches):
            counts = pc.value_counts(words.flatten())
            yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["word", "n"])

    return run


def _encode_words(vocabulary):
    def run(batches):
        tokenizer = vocabulary.open()
        for batch in batches:
            found = tokenizer.encode_batch(batch.column("word").to_pylist(), add_special_tokens=False)
            ids = pa.array([np.array(e.ids, "<u4").tobytes() for e in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("word"), ids, batch.column("step")], ["word", "ids", "step"])

    return run


def _encode_sorted(vocabulary, kind: str):
    """Ids in place of the words. Equal words follow each other, also across batches, and are encoded once."""
    def run(batches):
        tokenizer = vocabulary.open()
        last, last_ids = None, b""
        for batch in batches:
            if not batch.num_rows:
                continue
            distinct = pc.unique(batch.column("word"))
            words = distinct.to_pylist()
            known = [last_ids] if words[0] == last else []
            table = known + [np.array(e.ids, kind).tobytes() for e in tokenizer.encode_batch(words[len(known) :], add_special_tokens=False)]
            last, last_ids = words[-1], table[-1]
            payload = pa.array(table, pa.binary()).take(pc.index_in(batch.column("word"), value_set=distinct))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), batch.column("at"), payload], ["doc_id", "digest", "at", "payload"])

    return run


def _packed(numbers: np.ndarray, level: zstandard.ZstdCompressor) -> bytes:
    """Numbers below 2**24 as three planes of bytes, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T
    return level.compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(packed: bytes, level: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(level.decompress(packed), np.uint8).reshape(3, -1)
    numbers = np.zeros((planes.shape[1], 4), np.uint8)
    numbers[:, :3] = planes.T
    return numbers.view("<u4").ravel().astype(np.int64)


def _numbered(words: pa.ListArray, head: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word in the head from 1, holes for the others; and the ends of the rows."""
    found = pc.index_in(words.flatten(), value_set=head)
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1, words.offsets.to_numpy() - words.offsets[0].as_py()


def _skeletons(vocabulary, head):
    """Per row, at the place before its first word, its head words by number, with holes for the others."""
    def run(batches):
        level = zstandard.ZstdCompressor(level=3)
        for batch, words in _word_lists(vocabulary, batches):
            numbers, ends = _numbered(words, head.value[0])
            packed = pa.array([_packed(numbers[a:b], level) for a, b in zip(ends, ends[1:])], pa.binary())
            before = pa.array(np.full(batch.num_rows, -1, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), before, packed], ["doc_id", "digest", "at", "payload"])

    return run


def _tail(vocabulary, head):
    """The words that are not in the head, with their positions."""
    def run(batches):
        for batch, words in _word_lists(vocabulary, batches):
            numbers, ends = _numbered(words, head.value[0])
            holes = np.nonzero(numbers == _HOLE)[0]
            row = np.searchsorted(ends, holes, "right") - 1
            take = pa.array(row)
            at = pa.array((holes - ends[row]).astype(np.int32))
            columns = [batch.column("doc_id").take(take), batch.column("digest").take(take), at, words.flatten().take(pa.array(holes))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "at", "word"])

    return run


class _Ragged:
    """Rows of different lengths in one array, gathered without a loop. Row 0 is empty if ``hole``."""

    def __init__(self, rows: pa.Array, kind: str, hole: bool = False):
        size = np.dtype(kind).itemsize
        ends = np.frombuffer(rows.buffers()[1], np.int32)[: len(rows) + 1].astype(np.int64) // size if len(rows) else np.zeros(1, np.int64)
        self.flat = np.frombuffer(rows.buffers()[2] or b"", np.uint8)
        self.flat = self.flat[: len(self.flat) // size * size].view(kind)
        first = [0] if hole else []
        self.starts = np.concatenate([first, ends[:-1]]).astype(np.int64)
        self.lengths = np.concatenate([first, np.diff(ends)]).astype(np.int64)

    def take(self, rows: np.ndarray) -> np.ndarray:
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[rows] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at]


def _filled(numbers: np.ndarray, places: list[int], payloads: list[bytes], ids_of: _Ragged, kind: str) -> np.ndarray:
    """The ids of the head words, with those of the others put into the holes."""
    row = ids_of.take(numbers)
    if not places:
        return row
    before = np.cumsum(ids_of.lengths[numbers])[places]
    counts = [len(p) // np.dtype(kind).itemsize for p in payloads]
    return np.insert(row, np.repeat(before, counts), np.frombuffer(b"".join(payloads), kind))


def _assemble(head, pieces, kind: str):
    """Documents from rows in the order of document and place: first the skeletons, one for each copy, then the holes."""
    def finished(rows, piece_of, doc_type):
        decoded = [piece_of.take(row).tobytes().decode("utf-8", "replace") for _, row in rows]
        offsets = np.concatenate([[0], np.cumsum([len(row) for _, row in rows])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([row for _, row in rows]).astype(np.int32)))
        sums = [pa.array([hashlib.sha256(row.astype("<u4").tobytes()).hexdigest() for _, row in rows], pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]
        docs = pa.array([doc for doc, _ in rows], doc_type)
        return pa.RecordBatch.from_arrays([docs, lists, pa.array(decoded, pa.string()), *sums], ["doc_id", "ids", "decoded", "ids_sha256", "decoded_sha256"])

    def run(batches):
        ids_of, piece_of = _Ragged(head.value[1], "<u4", hole=True), _Ragged(pieces.value, "u1")
        level = zstandard.ZstdDecompressor()
        copies, key, numbers, places, payloads = [], None, None, [], []
        rows, size, doc_type = [], 0, None

        def close():
            row = _filled(numbers, places, payloads, ids_of, kind)
            rows.extend((doc, row) for doc in copies)
            return len(row) * len(copies)

        for batch in batches:
            doc_type, packed = batch.schema.field("doc_id").type, batch.column("payload")
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist())
            for n, (here, at) in enumerate(zip(keys, batch.column("at").to_pylist())):
                if at < 0 and copies and not places and here == key:
                    copies.append(here[0])
                elif at < 0:
                    size += close() if copies else 0
                    copies, key, numbers, places, payloads = [here[0]], here, _unpacked(packed[n].as_py(), level), [], []
                elif not places or at > places[-1]:  # once more for each copy otherwise
                    places.append(at)
                    payloads.append(packed[n].as_py())
                if len(rows) >= OUT_ROWS or size >= OUT_IDS:
                    for begin in range(0, len(rows), OUT_ROWS):
                        yield finished(rows[begin : begin + OUT_ROWS], piece_of, doc_type)
                    rows, size = [], 0
        if copies:
            close()
        for begin in range(0, len(rows), OUT_ROWS):
            yield finished(rows[begin : begin + OUT_ROWS], piece_of, doc_type)

    return run


def _head(rows: DataFrame, vocabulary: Vocabulary, head_words: int, scratch: Scratch) -> DataFrame:
    """(word, ids, step) of the words that are most frequent in a sample of the documents, bounded in number and bytes.

    Counts are looked at in steps of a sixteenth of a doubling, so that nothing has to be sorted in Spark.
    """
    share = F.lit(min(1.0, HEAD_DOCUMENTS / max(1, rows.count())))
    chosen = rows.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 40)) < share * (1 << 40))
    counted = chosen.select("words", "unknown").mapInArrow(_sample_words(vocabulary), "word string, n bigint")
    counted = counted.where(F.octet_length("word") <= LONG_BYTES).groupBy("word").agg(F.sum("n").alias("n"))
    counted = scratch.put(counted.withColumn("step", F.floor(F.log2("n") * 16)))
    words, size, cut = head_words, HEAD_BYTES, None
    steps = counted.groupBy("step").agg(F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word")).alias("bytes")).collect()
    for row in sorted(steps, key=lambda r: -r["step"]):
        words, size = words - row["words"], size - row["bytes"]
        if words < 0 or size < 0:
            break
        cut = row["step"]
    frequent = counted.where(F.lit(False) if cut is None else F.col("step") >= cut)
    return frequent.select("word", "step").mapInArrow(_encode_words(vocabulary), "word string, ids binary, step bigint")


def encode_documents(docs: DataFrame, vocabulary_path: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, ids array<int>, decoded, ids_sha256, decoded_sha256), one row for each of ``docs`` (doc_id, text).

    ``ids`` are what the tokenizers library gives for the whole text without added special tokens; ``decoded`` is made from
    the ids. The session's Arrow batches are kept to ``BATCH_ROWS`` rows from then on. Null texts count as empty: no ids and an empty text. A special token's string in a text is that token. Rows of the same
    doc_id and text give equal rows. Other columns are ignored; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    vocabulary = Vocabulary(vocabulary_path)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unknown = text.rlike(r"\p{Cn}")
    words = F.when(~unknown, words_of(text, list(vocabulary.special)))
    rows = docs.select("doc_id", F.xxhash64(text).alias("digest"), words.alias("words"), F.when(unknown, text).alias("unknown"))
    # In falling frequency, so that most numbers are small and the skeletons pack well.
    chosen = _head(rows, vocabulary, min(head_words, (1 << 24) - 2), scratch).toArrow().sort_by([("step", "descending")]).combine_chunks()
    columns = [chosen.column(name).combine_chunks() if chosen.num_rows else pa.array([], kind) for name, kind in (("word", pa.string()), ("ids", pa.binary()))]
    head = spark.sparkContext.broadcast(tuple(columns))
    table = vocabulary.piece_list()
    pieces, width = spark.sparkContext.broadcast(pa.array(table, pa.binary())), "<u2" if len(table) <= 1 << 16 else "<u4"

    doc_type = docs.schema["doc_id"].dataType
    key = [T.StructField("doc_id", doc_type), T.StructField("digest", T.LongType()), T.StructField("at", T.IntegerType())]
    placed = T.StructType([*key, T.StructField("payload", T.BinaryType())])
    skeletons = rows.mapInArrow(_skeletons(vocabulary, head), placed)
    tail = rows.mapInArrow(_tail(vocabulary, head), T.StructType([*key, T.StructField("word", T.StringType())]))
    # Words that a sample of frequent ones cannot hold, for their length, may still fill a third of the table.
    spread = F.when(F.octet_length("word") > LONG_BYTES, F.pmod(F.xxhash64("digest", "doc_id"), F.lit(LONG_SPREAD))).otherwise(F.lit(0))
    holes = tail.repartition("word", spread).sortWithinPartitions("word").mapInArrow(_encode_sorted(vocabulary, width), placed)
    met = skeletons.unionByName(holes).repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "at")
    schema = T.StructType([key[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return met.mapInArrow(_assemble(head, pieces, width), schema)


def decode_ids(frame: DataFrame, vocabulary_path: str) -> DataFrame:
    """``frame`` (doc_id, ids array<int>) to (doc_id, decoded), special tokens kept. Null ids give an empty text."""
    pieces = frame.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path).pieces())

    def run(batches):
        for batch in batches:
            texts = [b"".join([pieces.value[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    schema = T.StructType([T.StructField("doc_id", frame.schema["doc_id"].dataType), T.StructField("decoded", T.StringType())])
    return frame.select("doc_id", "ids").mapInArrow(run, schema)
