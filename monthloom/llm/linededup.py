"""Line dedup that can be taken back: sharded cuckoo filters over exact reference counts.

An index holds, as tables in the shared folder, which document refers to which line (a 128-bit
hash), how many documents refer to each line with the largest of them, and one small cuckoo filter
per shard of the lines that have reached the threshold.  Inserting documents adds references and
counts, deleting documents takes theirs away; a line that crosses the threshold either way enters
or leaves its shard's filter, so the index is afterwards as if a deleted document had never come.

The filters spare texts the way over the network: a document none of whose lines may be held stays
where it is.  What a filter lets through is decided by the exact counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from monthloom.llm.common import carried, stored

#: Held lines per shard at which an index is laid out; shards grow with the lines, filters do not.
SHARD_KEYS = 50_000
#: Filters up to this size travel to the tasks; beyond it, all references meet the counts in a join.
FILTER_BYTES = 32_000_000
#: Displacements before a filter gets a further table.
KICKS = 200

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = b" \t\n\x0b\x0c\r"
_KEY = pa.struct([("k1", pa.int64()), ("k2", pa.int64())])


def _digests(text: bytes | None, min_length: int) -> list[bytes]:
    """The hash of each line's key, in order; empty for lines too short to count."""
    found = []
    for line in (text or b"").translate(_LOWER).split(b"\n"):
        key = line.strip(_SPACE)
        n = len(key)
        long = n >= 4 * min_length or (n >= min_length and len(key.decode()) >= min_length)
        found.append(xxh3_128_digest(key) if long else b"")
    return found


def _texts(column: pa.Array) -> list:
    return column.cast(pa.large_binary()).to_pylist()


def _key_lists(lists: list[list[bytes]], choose=None) -> pa.Array:
    """Lists of distinct keys, as an Arrow column; ``choose`` says which keys stay."""
    off = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    flat = np.frombuffer(b"".join(d for x in lists for d in x), dtype="<i8").reshape(-1, 2)
    if choose is not None:
        stay = choose(flat[:, 0], flat[:, 1])
        off = np.concatenate(([0], np.cumsum(stay)))[off]
        flat = flat[stay]
    keys = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in (0, 1)], fields=list(_KEY))
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), keys)


def _slots(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, bucket bits, and what leads from one bucket to the other."""
    mark = (k2.view(np.uint64) % np.uint64(65535)).astype(np.int64) + 1
    return mark, (k1.view(np.uint64) >> np.uint64(20)).astype(np.int64), (mark * 0x5BD1E995) >> 3


class Cuckoo:
    """Fingerprints of 16 bits in buckets of four; a full filter gets a further table of twice the size."""

    def __init__(self, tables=()):
        self.tables = [np.frombuffer(t, "<u2").tolist() for t in tables]

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        made = cls()
        made.tables = [[0] * (4 << max(int(keys * 1.25) // 4, 15).bit_length())]
        return made

    def dump(self) -> list[bytes]:
        return [np.array(t, "<u2").tobytes() for t in self.tables]

    def add(self, mark: int, bits: int, way: int) -> None:
        for table in self.tables:
            mask = len(table) // 4 - 1
            for bucket in (bits & mask, (bits ^ way) & mask):
                for slot in range(4 * bucket, 4 * bucket + 4):
                    if not table[slot]:
                        table[slot] = mark
                        return
        if not self._displace(self.tables[-1], mark, bits):
            self.tables.append([0] * (2 * len(self.tables[-1])))
            self.add(mark, bits, way)

    @staticmethod
    def _displace(table, mark, bits) -> bool:
        mask, moved = len(table) // 4 - 1, []
        bucket = bits & mask
        for kick in range(KICKS):
            slot = 4 * bucket + (kick * 7 + mark) % 4
            moved.append((slot, table[slot]))
            table[slot], mark = mark, table[slot]
            bucket = (bucket ^ ((mark * 0x5BD1E995) >> 3)) & mask
            for free in range(4 * bucket, 4 * bucket + 4):
                if not table[free]:
                    table[free] = mark
                    return True
        for slot, old in reversed(moved):
            table[slot] = old
        return False

    def remove(self, mark: int, bits: int, way: int) -> None:
        for table in self.tables:
            mask = len(table) // 4 - 1
            for bucket in (bits & mask, (bits ^ way) & mask):
                for slot in range(4 * bucket, 4 * bucket + 4):
                    if table[slot] == mark:
                        table[slot] = 0
                        return
        raise ValueError("a line was taken from a filter that does not hold it")


class Shards:
    """The filters of all shards, asked for many keys at once."""

    def __init__(self, rows, shards: int):
        depth = max((len(r["tables"]) for r in rows), default=0)
        self.shards = shards
        self.mask = np.full((depth, shards), -1, np.int64)
        self.base = np.zeros((depth, shards), np.int64)
        flat, at = [np.zeros(4, np.uint16)], 4
        for r in rows:
            for level, table in enumerate(r["tables"]):
                cells = np.frombuffer(table, "<u2")
                self.base[level, r["shard"]], self.mask[level, r["shard"]] = at, len(cells) // 4 - 1
                flat.append(cells)
                at += len(cells)
        self.cells = np.concatenate(flat)

    def may_hold(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        shard = k1 % self.shards
        mark, bits, way = _slots(np.ascontiguousarray(k1), np.ascontiguousarray(k2))
        found = np.zeros(len(k1), bool)
        for base, mask in zip(self.base, self.mask, strict=True):
            there = mask[shard] >= 0
            for bucket in (bits, bits ^ way):
                first = base[shard] + 4 * (bucket & np.maximum(mask[shard], 0))
                for slot in range(4):
                    found |= there & (self.cells[np.where(there, first, 0) + slot] == mark)
        return found


@dataclass(frozen=True)
class LineIndex:
    """References ``doc_id, k1, k2``; counts ``k1, k2, n_docs, top_doc``; filters ``shard, tables``."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_length: int

    def held(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)


def _shard(shards: int):
    return F.pmod("k1", F.lit(shards)).cast("int").alias("shard")


def _references(docs: DataFrame, min_length: int) -> DataFrame:
    @F.arrow_udf("array<struct<k1:long,k2:long>>")
    def keys(text: pa.Array) -> pa.Array:
        return _key_lists([sorted(set(_digests(t, min_length)) - {b""}) for t in _texts(text)])

    lines = docs.select("doc_id", F.explode(keys("text")).alias("k"))
    return lines.select("doc_id", "k.k1", "k.k2").distinct()


def _counted(references: DataFrame) -> DataFrame:
    return references.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top_doc"))


def _filters(changes: DataFrame, shards: int, old: DataFrame | None = None) -> DataFrame:
    """Filters after ``changes`` (k1, k2, add); a group is one shard's filter and the lines that crossed the threshold."""
    rows = changes.select(_shard(shards), "k1", "k2", "add", F.lit(None).cast("array<binary>").alias("tables"))
    if old is not None:
        none = F.lit(None).cast("long")
        rows = rows.unionByName(old.select("shard", none.alias("k1"), none.alias("k2"), F.lit(None).cast("boolean").alias("add"), "tables"))

    def build(group: pa.Table) -> pa.Table:
        known = [t for t in group.column("tables").to_pylist() if t is not None]
        changed = group.filter(pc.is_valid(group.column("add"))).sort_by([("k1", "ascending"), ("k2", "ascending")])
        cuckoo = Cuckoo(known[0]) if known else Cuckoo.sized(changed.num_rows)
        k1, k2 = (changed.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
        add = changed.column("add").to_pylist()
        steps = list(zip(add, *(x.tolist() for x in _slots(k1, k2)), strict=True))
        for new, *key in sorted(steps, key=lambda s: s[0]):  # those that leave make room first
            (cuckoo.add if new else cuckoo.remove)(*key)
        out = pa.schema([("shard", pa.int32()), ("tables", pa.list_(pa.binary()))])
        return pa.table({"shard": [group.column("shard")[0].as_py()], "tables": [cuckoo.dump()]}, schema=out)

    return rows.groupBy("shard").applyInArrow(build, "shard int, tables array<binary>")


def _laid_out(references: DataFrame, counts: DataFrame, min_docs: int, min_length: int) -> LineIndex:
    held = counts.where(F.col("n_docs") >= min_docs)
    shards = 1 << (held.count() // SHARD_KEYS).bit_length()
    filters = stored(_filters(held.select("k1", "k2", F.lit(True).alias("add")), shards), "line-filters")
    return LineIndex(references, counts, filters, shards, min_docs, min_length)


def build(docs: DataFrame, min_docs: int = 3, min_length: int = 20) -> LineIndex:
    """An index of the lines of ``docs`` (``doc_id``, ``text``).

    A line's key is the line without spaces, tabs and line ends around it, A-Z lower-cased; keys of
    fewer than ``min_length`` code points are never counted.  A document refers to a key once,
    however often it holds it; rows of one ``doc_id`` are one document, and so are those without
    one, which is smaller than all others.  A null text is one empty line.  Texts are read whole.
    """
    references = stored(_references(docs, min_length), "line-references")
    return _laid_out(references, stored(_counted(references), "line-counts"), min_docs, min_length)


def _crossed(before: DataFrame, after: DataFrame, min_docs: int) -> DataFrame:
    was = before.where(F.col("n_docs") >= min_docs).select("k1", "k2")
    now = after.where(F.col("n_docs") >= min_docs).select("k1", "k2")
    risen = now.join(was, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(True).alias("add"))
    return risen.unionByName(was.join(now, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(False).alias("add")))


def _changed(index: LineIndex, references: DataFrame, counts: DataFrame) -> LineIndex:
    counts = stored(counts, "line-counts")
    if counts.where(F.col("n_docs") >= index.min_docs).count() > 4 * SHARD_KEYS * index.shards:
        return _laid_out(references, counts, index.min_docs, index.min_length)
    filters = _filters(_crossed(index.counts, counts, index.min_docs), index.shards, index.filters)
    return LineIndex(references, counts, stored(filters, "line-filters"), index.shards, index.min_docs, index.min_length)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with further documents.  What a document already refers to is not counted again."""
    known = index.references.select(F.col("doc_id").alias("d"), F.col("k1").alias("a"), F.col("k2").alias("b"))
    new = _references(docs, index.min_length)
    new = stored(new.join(known, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b")), "left_anti"), "line-references")
    both = index.counts.unionByName(_counted(new)).groupBy("k1", "k2")
    return _changed(index, index.references.unionByName(new), both.agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc")))


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index as if the documents with these ``doc_id`` had never come; unknown ids and nulls change nothing."""
    ids = ids.select("doc_id").distinct()
    left = stored(index.references.join(ids, "doc_id", "left_anti"), "line-references")
    touched = stored(index.references.join(ids, "doc_id", "left_semi").select("k1", "k2").distinct(), "line-touched")
    again = _counted(left.join(touched, ["k1", "k2"], "left_semi"))
    return _changed(index, left, index.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(again))


def _filter_bytes(index: LineIndex) -> int:
    size = F.aggregate("tables", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t))
    return index.filters.agg(F.sum(size)).first()[0] or 0


def _suspects(spark: SparkSession, index: LineIndex):
    """Column of the keys of a text that may be held, by the filters."""
    shards = carried(spark, Shards(index.filters.collect(), index.shards))
    min_length, got = index.min_length, []

    @F.arrow_udf("array<struct<k1:long,k2:long>>")
    def keys(text: pa.Array) -> pa.Array:
        if not got:  # once per task
            got.append(shards())
        return _key_lists([sorted(set(_digests(t, min_length)) - {b""}) for t in _texts(text)], got[0].may_hold)

    return keys


def kept(docs: DataFrame, index: LineIndex) -> DataFrame:
    """``docs`` with ``__lines`` (``text`` kept, ``n_lines`` before, ``n_dropped``).

    A line goes if at least ``min_docs`` documents of the index hold its key and another document
    is the largest of them; repeated within a document, it goes everywhere.  Other lines stay as they were, joined by
    ``\\n``; a null or empty text is one empty line.  Repeated rows are all judged alike; an empty
    table gives an empty one.  Further columns are left alone, but for one named ``__lines``, which
    is replaced.
    """
    spark, min_length = docs.sparkSession, index.min_length
    # own columns stand in a struct, so that no name of theirs meets one used here
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "__lines"]
    docs = docs.select(F.struct(*columns).alias("__row"), "doc_id", "text")
    whole = F.coalesce("text", F.lit(""))

    @F.arrow_udf("struct<text:string,n_lines:long,n_dropped:long>")
    def without(text: pa.Array, gone: pa.Array) -> pa.Array:
        texts, lines, dropped = [], [], []
        for t, keys in zip(_texts(text), gone.to_pylist(), strict=True):
            bad = {np.array([k["k1"], k["k2"]], "<i8").tobytes() for k in keys}
            parts = (t or b"").split(b"\n")
            stay = [p for p, d in zip(parts, _digests(t, min_length), strict=True) if d not in bad]
            texts.append(b"\n".join(stay))
            lines.append(len(parts))
            dropped.append(len(parts) - len(stay))
        return pa.StructArray.from_arrays(
            [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
            ["text", "n_lines", "n_dropped"],
        )

    n_lines = (F.length(whole) - F.length(F.translate(whole, "\n", "")) + 1).cast("long")
    untouched = F.struct(whole.alias("text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).alias("__lines")
    held = index.held().select("k1", "k2", "top_doc")
    if _filter_bytes(index) <= FILTER_BYTES:
        marked = docs.select("*", _suspects(spark, index)("text").alias("__may"))
        asked = marked.select("doc_id", F.explode("__may").alias("k")).select("doc_id", "k.k1", "k.k2")
        clean, open_ = marked.where(F.size("__may") == 0), marked.where(F.size("__may") > 0)
    else:
        asked, clean, open_ = _references(docs, min_length), None, docs
    bad = asked.join(held, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("top_doc")))
    bad = bad.groupBy(F.col("doc_id").alias("__d")).agg(F.collect_set(F.struct("k1", "k2")).alias("__gone"))
    gone = F.coalesce("__gone", F.array().cast("array<struct<k1:long,k2:long>>"))
    judged = open_.join(bad, F.col("doc_id").eqNullSafe(F.col("__d")), "left")
    out = judged.select("__row", without("text", gone).alias("__lines"))
    if clean is not None:
        out = out.unionByName(clean.select("__row", untouched))
    return out.select("__row.*", "__lines")


def digest(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2("__lines.text", 256).alias("kept_sha256"))
