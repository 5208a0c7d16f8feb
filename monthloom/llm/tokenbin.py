"""Token ids of a corpus in Arrow files of equal-length rows.

A corpus folder holds ``part-*.arrow`` files (Arrow IPC file format, not compressed, so that a
memory-mapped row is read in place) and a Parquet table ``manifest`` that names the files in
order.  Every row of a file is one sequence of ``length`` ids:

* ``ids``    fixed_size_list<uint16 or uint32>[length]
* ``mask``   fixed_size_list<bool>[length], false where the last row of a file is filled up
* ``docs``   list<int64>, ids of the documents that begin in this row
* ``begins`` list<int32>, where in the row each of them begins

A document may run over several rows but never over files.  A task writes under a name of its
own and only files named by the manifest belong to the corpus, so that a repeated or
speculative task, or one that dies half way, leaves nothing behind that is read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm.common import scratch, sliced

_MANIFEST = "part int, first_doc long, path string, n_rows long, n_docs long, n_ids long"


def file_system(uri: str):
    """The file system of a path and the path on it; any scheme that Arrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Encoder:
    """Ids of texts through the ``tokenizers`` library, each distinct stretch encoded once.

    A byte-level BPE never merges over the start of a word.  A text is cut before every blank
    that stands between other characters; the stretches are looked up, and the missing ones
    encoded together.  Texts where that cut could matter (blanks next to other white space,
    special tokens) are encoded as they stand.  At most ``room`` stretches of ``held_bytes`` together are
    remembered, none of more than ``LONG`` characters beyond the call that met it.
    """

    # U+0000 joins missing stretches: no merge of the vocabulary has it
    _JOIN = "\x00"
    _MARKS = ".,;:!?#*$%&|"

    #: Bytes that a remembered stretch takes besides its characters and ids.
    _EACH = 190
    LONG = 200

    def __init__(self, path: str, room: int = 1_700_000, held_bytes: int = 400_000_000):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.room, self.held_bytes, self.known, self.held, self.long = room, held_bytes, {}, 0, []
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.odd = re.compile(r"\s (?:\s|\Z)|<\||\x00").search
        # cheap signs that a text may be odd
        self.signs = ("  ", "\n ", "\t ", "\r ", "<|", "\x00")
        self.rare = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        # how a byte-level model writes bytes: printable ones as they are, the others from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.written = {b: 256 + k for k, b in enumerate(hidden)}
        self.blank, self.model = chr(self.written[32]), self.tokenizer.model
        self.code = "I" if self.wide else "H"
        try:  # one word is one call of the model, if the model works on words as it should
            self.by_word = all(
                self._word(w) == self.tokenizer.encode(" " + w, add_special_tokens=False).ids
                for w in ("the", "Zeitung", "niño", "éèö", "слово", "日本語", "qzvjxk")
            )
        except Exception:
            self.by_word = False
        ids = self.tokenizer.encode(self._JOIN, add_special_tokens=False).ids
        joins = [t for t in self.tokenizer.get_vocab() if self.tokenizer.id_to_token(ids[0]) in t] if len(ids) == 1 else []
        self.joint = ids[0] if len(joins) == 1 else None  # else nothing is joined

    def _word(self, word: str) -> list[int]:
        """Ids of a blank and some letters."""
        if word.isascii():
            raw = self.blank + word
        else:
            raw = self.blank + word.encode("utf-8", "replace").decode("latin-1").translate(self.written)
        return [t.id for t in self.model.tokenize(raw)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _learn(self, missing: list[str]) -> None:
        """``missing`` are what stands between blanks; those that begin a text are marked by U+0000."""
        size, known, words, ended = self.dtype.itemsize, self.known, {}, []
        for s in missing:
            word = s.rstrip(self._MARKS)
            if len(word) < len(s) and word.isalpha():  # letters, then marks: two stretches that never merge
                ended.append((s, word, s[len(word) :]))
                words[word] = None
            else:
                words[s] = None
        marks = {"\x00" + m for _, _, m in ended}
        fresh = [s for s in (*words, *marks) if s not in known]
        if len(known) + len(fresh) + len(ended) > self.room or self.held > self.held_bytes:
            known.clear()
            self.held = 0
            fresh = [*words, *marks]
        alone, joined, word, code = [], [], self._word, self.code
        for s in fresh:
            if self.by_word and s.isalpha():
                known[s] = array(code, word(s)).tobytes()
                continue
            stretch = s[1:] if s[:1] == self._JOIN else " " + s
            # joined, a leading apostrophe or white space at the end would be cut otherwise
            odd = self.joint is None or stretch[:1] == "'" or stretch[-1:].isspace()
            (alone if odd else joined).append((s, stretch))
        known.update(zip([s for s, _ in alone], self._plain([x for _, x in alone]), strict=True))
        for i in range(0, len(joined), 2000):
            part = joined[i : i + 2000]
            text = self._JOIN.join([x for _, x in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = (np.flatnonzero(ids == self.joint) * size).tolist()
            raw, a = ids.tobytes(), 0
            for (s, _), b in zip(part, [*ends, len(raw)], strict=True):
                known[s] = raw[a:b]
                a = b + size
        for s, base, m in ended:
            known[s] = known[base] + known["\x00" + m]
        # ids are shorter than the text they stand for
        self.held += self._EACH * (len(fresh) + len(ended)) + 2 * sum(map(len, fresh)) + 2 * sum(len(s) for s, _, _ in ended)
        self.long += [s for s in (*fresh, *(s for s, _, _ in ended)) if len(s) > self.LONG]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; null is empty."""
        cut, plain = {}, {}
        for i, text in enumerate(texts):
            if not text:
                plain[i] = b""
            elif (any(x in text for x in self.signs) or self.rare(text)) and self.odd(text):
                plain[i] = self._plain([text])[0]
            else:
                cut[i] = text.split(" ")
                cut[i][0] = self._JOIN + cut[i][0]
        wanted = set().union(*cut.values()) if cut else set()
        wanted.discard(self._JOIN)
        if 3 * len(wanted) >= self.room or 3 * (self._EACH * len(wanted) + 2 * sum(map(len, wanted))) >= self.held_bytes:
            return [plain[i] if i in plain else self._plain([texts[i]])[0] for i in range(len(texts))]
        for _ in range(2):  # learning may empty the memory: what this batch needs then comes back
            missing = [s for s in wanted if s not in self.known]
            if missing:
                self._learn(missing)
        known = self.known
        known[self._JOIN] = b""  # a text that begins with a blank
        out = [plain[i] if i in plain else b"".join([known[s] for s in cut[i]]) for i in range(len(texts))]
        for s in self.long:
            known.pop(s, None)
        self.long = []
        return out


def encoder_of_worker(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer, kept between the tasks it runs."""
    import sys

    kept = sys.__dict__.setdefault("_monthloom_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``) its ``doc_id`` and ``length``: the ids that
    ``write_corpus`` writes for it, with the end id.

    A null or empty text has length 1.  Nothing is shuffled; who reads the lengths several times
    stores them, as every reading encodes the texts.
    """

    def count(batches):
        for part, _, _ in sliced(batches):
            encode = encoder_of_worker(tokenizer)
            size = encode.dtype.itemsize
            lengths = [len(ids) // size + 1 for ids in encode(part.column("text").to_pylist())]
            yield pa.record_batch([part.column("doc_id"), pa.array(lengths, pa.int64())], names=["doc_id", "length"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, length long")


class _Writer:
    """Cuts a stream of documents into rows and writes them in batches."""

    def __init__(self, sink, dtype, length: int, batch_rows: int):
        self.length, self.batch_rows, self.dtype = length, batch_rows, dtype
        values = pa.uint32() if dtype.itemsize == 4 else pa.uint16()
        self.schema = pa.schema(
            [
                ("ids", pa.list_(values, length)),
                ("mask", pa.list_(pa.bool_(), length)),
                ("docs", pa.list_(pa.int64())),
                ("begins", pa.list_(pa.int32())),
            ]
        )
        self.file = pa.ipc.new_file(sink, self.schema)
        self.left, self.held, self.docs, self.begins = [], 0, [], []
        self.n_rows = self.n_docs = self.n_ids = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.begins.append(self.held)
        self.left.append(ids)
        self.held += len(ids)
        self.n_docs += 1
        self.n_ids += len(ids)
        if self.held >= self.length * self.batch_rows:
            self._flush(self.held // self.length)

    def _flush(self, rows: int, fill: bool = False) -> None:
        ids = np.concatenate(self.left) if self.left else np.zeros(0, self.dtype)
        real = min(len(ids), rows * self.length)
        rest = ids[real:]
        block = np.zeros(rows * self.length, self.dtype)
        block[:real] = ids[:real]
        mask = np.arange(rows * self.length) < real
        begins = np.array(self.begins, np.int64)
        now = int(np.searchsorted(begins, real))  # documents that begin in these rows
        at = begins[:now] // self.length
        offsets = np.searchsorted(at, np.arange(rows + 1)).astype(np.int32)
        schema = self.schema
        values = schema.field("ids").type.value_type
        self.file.write_batch(
            pa.record_batch(
                [
                    pa.FixedSizeListArray.from_arrays(pa.array(block, values), self.length),
                    pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
                    pa.ListArray.from_arrays(offsets, pa.array(self.docs[:now], pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array((begins[:now] % self.length).astype(np.int32))),
                ],
                schema=schema,
            )
        )
        self.docs, self.begins = self.docs[now:], [int(b) - real for b in begins[now:]]
        self.left, self.held = [rest] if len(rest) else [], len(rest)
        self.n_rows += rows

    def close(self) -> None:
        if self.held:
            self._flush(-(-self.held // self.length))
        self.file.close()


def write_corpus(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    length: int = 2048,
    end_id: int = 0,
    batch_rows: int = 256,
    partitions: int | None = None,
) -> DataFrame:
    """Writes ``docs`` (``doc_id``, ``text``) under ``folder`` and returns the manifest as stored.

    Documents go by ascending ``doc_id`` over a range partitioning (rows without an id first, rows
    of one id by a hash of their text, so that a repeated id does not pile up), each followed by
    ``end_id``.  A null text is empty, which leaves the end id alone.  ``tokenizer`` is the path of
    a ``tokenizers`` file that every executor can read.  An empty table gives an empty manifest.
    """
    spark = docs.sparkSession

    def write(batches):
        from pyspark import TaskContext

        encode, writer, sink, path, first, part = None, None, None, None, None, TaskContext.get().partitionId()
        for batch in batches:
            if writer is None and batch.num_rows:
                encode = encoder_of_worker(tokenizer)
                path = f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.arrow"
                system, place = file_system(path)
                system.create_dir(os.path.dirname(place), recursive=True)
                sink = system.open_output_stream(place)
                writer = _Writer(sink, encode.dtype, length, batch_rows)
                first = batch.column("doc_id")[0].as_py()
            end = np.array([end_id], encode.dtype if encode else np.uint16).tobytes()
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                ids = encode(rows.column("text").to_pylist())
                for doc_id, found in zip(rows.column("doc_id").to_pylist(), ids, strict=True):
                    writer.add(doc_id, np.frombuffer(found + end, encode.dtype))
        if writer is not None:
            writer.close()
            sink.close()
            made = [[part], [first], [path], [writer.n_rows], [writer.n_docs], [writer.n_ids]]
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["part", "first_doc", "path", "n_rows", "n_docs", "n_ids"]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names=names)

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("h"))
        .repartitionByRange(n, "doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
        .select("doc_id", "text")
    )
    placed.mapInArrow(write, _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start_id`` and ``start_row``: ids and rows of all files before."""
    files = manifest.orderBy("part").collect()  # one row per file
    rows, ids, seq = [], 0, 0
    for f in files:
        rows.append((f["path"], f["n_docs"], ids, seq))
        ids, seq = ids + f["n_ids"], seq + f["n_rows"]
    return manifest.sparkSession.createDataFrame(rows, "path string, n_docs long, start_id long, start_row long")


def open_corpus(path: str) -> pa.ipc.RecordBatchFileReader:
    """One file of a corpus, memory-mapped where the file system is local."""
    from pyarrow import fs

    system, place = file_system(path)
    if isinstance(system, fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(place))
    return pa.ipc.open_file(system.open_input_file(place))


def sequence(path: str, row: int, batch_rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of one row of a file; the ids are a view of the mapped file.

    All batches but the last have the same number of rows or more, so the batch is found by
    walking the footer's batches; nothing but that batch is touched.
    """
    reader = open_corpus(path)
    for b in range(reader.num_record_batches):
        batch = reader.get_batch(b)
        if row < batch.num_rows:
            ids, mask = batch.column("ids"), batch.column("mask")
            n = ids.type.list_size
            return (
                ids.values.slice((ids.offset + row) * n, n).to_numpy(zero_copy_only=True),
                mask.values.slice((mask.offset + row) * n, n).to_numpy(zero_copy_only=False),
            )
        row -= batch.num_rows
    raise IndexError(row)


def documents_of(path: str):
    """(doc_id, ids) of the documents of one file, in order, holding one batch and one document."""
    reader, doc, parts = open_corpus(path), None, None
    for b in range(reader.num_record_batches):
        batch = reader.get_batch(b)
        ids = batch.column("ids")
        n = ids.type.list_size
        flat = ids.flatten().to_numpy(zero_copy_only=True)
        real = int(np.count_nonzero(batch.column("mask").flatten().to_numpy(zero_copy_only=False)))
        row_of = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("docs").offsets.to_numpy()))
        begins = row_of * n + batch.column("begins").flatten().to_numpy()
        edges = [*begins.tolist(), real]
        head = flat[: edges[0]]
        if parts is not None and len(head):
            parts.append(head.copy())
        for k, name in enumerate(batch.column("docs").flatten().to_pylist()):
            if parts is not None:
                yield doc, np.concatenate(parts)
            doc, parts = name, [flat[edges[k] : edges[k + 1]].copy()]
    if parts is not None:
        yield doc, np.concatenate(parts)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids_crc32`` (of its ids as little-endian unsigned 32-bit integers)."""
    files = with_starts(read_manifest(spark, folder))

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start_id").to_pylist(), strict=True):
                docs, starts, counts, sums = [], [], [], []
                for doc, ids in documents_of(path):
                    docs.append(doc)
                    starts.append(start)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    start += len(ids)
                yield pa.record_batch(
                    [pa.array(docs, pa.int64()), *[pa.array(x, pa.int64()) for x in (starts, counts, sums)]],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # a file to a task
    n = max(1, files.count())
    return files.repartitionByRange(n, "start_id").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def write_and_read(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """``read_documents`` of a corpus written to the shared folder."""
    folder = scratch(docs.sparkSession, "tokens")
    write_corpus(docs, folder, tokenizer, length, end_id)
    return read_documents(docs.sparkSession, folder)
