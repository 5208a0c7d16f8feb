"""Passages of benchmark items inside documents, by a prefix-filtered set join.

An item is cut into windows of ``window`` words (a shorter item is one window), a window into
shingles of ``shingle`` words.  A window occurs where a document holds at least a share
``containment`` of its shingles in their places.  With ``m`` shingles, ``m - ceil(containment * m) + 1``
of them are enough to be sure of meeting one in any document that holds the window: the rarest
over all documents are taken.  Documents are joined with these prefix shingles only; a match
fixes where the window would begin, which must leave room for all of it (length and position);
what is left is compared word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm import shingles as S
from monthloom.llm.common import carried, row_slices, sliced, stored, text_buffers



def _ceil_share(share: float, m: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.ceil(share * m - 1e-9).astype(np.int64))


class Windows:
    """Distinct windows of some items as arrays, and which items have each."""

    def __init__(self, item_ids, words: np.ndarray, counts: np.ndarray, window: int, shingle: int):
        ends = np.cumsum(counts)
        item = np.repeat(np.arange(len(counts)), counts)
        long_at = np.flatnonzero(np.arange(len(words)) + window <= np.repeat(ends, counts))
        short = np.flatnonzero((counts > 0) & (counts < window))
        at = np.concatenate([long_at, ends[short] - counts[short]])
        size = np.concatenate([np.full(len(long_at), window), counts[short]]).astype(np.int64)
        owner = np.concatenate([item[long_at], short])
        text = np.zeros((len(at), window), np.uint64)
        for j in range(window):
            here = size > j
            text[here, j] = words[at[here] + j]
        whole, index = np.unique(np.column_stack([size.astype(np.uint64), text]), axis=0, return_inverse=True)
        self.size, self.text = whole[:, 0].astype(np.int64), np.ascontiguousarray(whole[:, 1:])
        pairs = np.unique(np.column_stack([index.reshape(-1), owner]), axis=0)
        self.first_owner = np.searchsorted(pairs[:, 0], np.arange(len(whole) + 1))
        self.owners = np.array([item_ids[i] for i in pairs[:, 1]], dtype=object)
        self.k = np.minimum(shingle, self.size)
        self.m = self.size - self.k + 1

    def shingle_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, window, offset, words) of every shingle of every window."""
        parts = []
        for k in np.unique(self.k):
            mine = np.flatnonzero(self.k == k)
            for o in range(int(self.m[mine].max()) if len(mine) else 0):
                w = mine[self.m[mine] > o]
                flat = self.text[w].reshape(-1)
                parts.append((S.folded(flat, np.arange(len(w)) * self.text.shape[1] + o, int(k)), w, np.full(len(w), o), np.full(len(w), k)))
        if not parts:
            return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Probe:
    """Prefix shingles of windows, sorted by hash, and the comparison behind them."""

    def __init__(self, windows: Windows, frequency: dict[int, int], containment: float):
        h, w, o, k = windows.shingle_table()
        df = np.array([frequency.get(int(x), 0) for x in h.view(np.int64)], np.int64)
        order = np.lexsort((o, h, df, w))
        h, w, o, k, df = (x[order] for x in (h, w, o, k, df))
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        self.need = _ceil_share(containment, windows.m)
        keep = (rank <= windows.m[w] - self.need[w]) & (df > 0)
        h, w, o, k = (x[keep] for x in (h, w, o, k))
        order = np.argsort(h, kind="stable")
        self.h, self.w, self.o, k = (x[order] for x in (h, w, o, k))
        self.sizes = np.unique(k).tolist()
        self.windows = windows

    def occurrences(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every window that occurs, words numbered through all rows."""
        win = self.windows
        ends = np.cumsum(counts)
        end_of, begin_of = np.repeat(ends, counts), np.repeat(ends - counts, counts)
        found = []
        for k in self.sizes:
            at = np.flatnonzero(np.arange(len(words)) + k <= end_of)
            h = S.folded(words, at, k)
            lo = np.searchsorted(self.h, h, side="left")
            near = np.flatnonzero(self.h[np.minimum(lo, len(self.h) - 1)] == h) if len(self.h) else np.zeros(0, np.int64)
            at, lo = at[near], lo[near]
            n = np.searchsorted(self.h, h[near], side="right") - lo
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            w, start = self.w[entry], at - self.o[entry]
            room = (win.k[w] == k) & (start >= begin_of[at]) & (start + win.size[w] <= end_of[at])
            found.append(np.column_stack([start[room], w[room]]))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return self.verified(words, pairs[:, 0], pairs[:, 1])

    def verified(self, words, start, w):
        win = self.windows
        same = np.zeros((len(start), win.text.shape[1]), bool)
        for j in range(win.text.shape[1]):
            here = np.flatnonzero(win.size[w] > j)
            same[here, j] = words[start[here] + j] == win.text[w[here], j]
        run, equal = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for j in range(win.text.shape[1]):
            run = np.where(same[:, j], run + 1, 0)
            equal += run >= win.k[w]
        ok = equal >= self.need[w]
        return start[ok], w[ok]

    def per_row(self, words, counts):
        """(words hit, items) of each row."""
        start, w = self.occurrences(words, counts)
        rows = len(counts)
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + self.windows.size[w], -1)
        row_of = np.repeat(np.arange(rows), counts)
        hit = np.bincount(row_of[np.cumsum(cover[:-1]) > 0], minlength=rows)
        items: list[list] = [[] for _ in range(rows)]
        for r, x in np.unique(np.column_stack([row_of[start], w]), axis=0).tolist() if len(start) else ():
            items[r].extend(self.windows.owners[self.windows.first_owner[x] : self.windows.first_owner[x + 1]])
        return hit, [sorted(set(x), key=lambda v: (v is None, v)) for x in items]


def _words_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    return S.word_hashes(*text_buffers(pa.array(texts, pa.string())), S.ALNUM)


def matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    shingle: int = 5,
    containment: float = 1.0,
    broadcast_bytes: int = 32_000_000,
) -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``n_hit`` (words inside an occurring window) and ``items``.

    ``items`` are the distinct ids, ascending, of the items of which some window occurs.  Words
    are runs of digits, letters and characters beyond ASCII, A-Z lowered.  A null or empty text
    has no words; an item without words has no window and matches nothing; an item id may be null
    or repeated.  Every row of ``docs`` gives a row, repeated rows and null ids included.

    Where all item texts together are at most ``broadcast_bytes``, their windows travel to the
    tasks and documents are not shuffled at all; beyond it both sides are joined by a shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    if _small(items, broadcast_bytes):
        found = _finder(docs, items, window, shingle, containment)(F.col("text"))
        return docs.select("doc_id", found.alias("m")).select("doc_id", "m.*")
    return _matches_large(docs, items, window, shingle, containment)


def _small(items: DataFrame, broadcast_bytes: int) -> bool:
    return (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= broadcast_bytes


def _finder(docs, items, window, shingle, containment):
    """A function from text to (n_words, n_hit, items) that carries the items' windows."""
    spark = docs.sparkSession
    rows = items.where(F.col("text").isNotNull()).orderBy("item_id", "text").collect()  # within broadcast_bytes
    windows = Windows([r["item_id"] for r in rows], *_words_of([r["text"] for r in rows]), window, shingle)
    table, _, _, sizes = windows.shingle_table()
    known = np.unique(table)
    known_sizes = np.unique(sizes).tolist()
    get = carried(spark, (known, known_sizes))

    def count(batches):
        wanted, ks = get()
        total = np.zeros(len(wanted), np.int64)
        for _, data, off in sliced(batches):
            words, counts = S.word_hashes(data, off, S.ALNUM)
            ends = np.cumsum(counts)
            end_of, row_of = np.repeat(ends, counts), np.repeat(np.arange(len(counts)), counts)
            for k in ks:
                at = np.flatnonzero(np.arange(len(words)) + k <= end_of)
                h = S.folded(words, at, k)
                place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                here = wanted[place] == h
                pair = np.unique(row_of[at[here]] * len(wanted) + place[here])
                total += np.bincount(pair % len(wanted), minlength=len(wanted))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], names=["h", "c"])

    frequency = {}
    if len(known):
        partial = docs.select("text").mapInArrow(count, "h long, c long")
        frequency = {r["h"]: r["c"] for r in partial.groupBy("h").agg(F.sum("c").alias("c")).collect()}
    probe = carried(spark, Probe(windows, frequency, containment))

    @F.arrow_udf("n_words long, n_hit long, items array<long>")
    def find(text: pa.Array) -> pa.Array:
        index, parts = probe(), []
        data, off = text_buffers(text)
        for a, b in row_slices(off):
            words, counts = S.word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a], S.ALNUM)
            hit, found = index.per_row(words, counts)
            parts.append(
                pa.StructArray.from_arrays(
                    [pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                    names=["n_words", "n_hit", "items"],
                )
            )
        return pa.concat_arrays(parts)

    return find


def _matches_large(docs, items, window, shingle, containment, with_hash=False):
    def of_items(batches):
        for part, data, off in sliced(batches):
            words, counts = S.word_hashes(data, off, S.ALNUM)
            win = Windows(part.column("item_id").to_pylist(), words, counts, window, shingle)
            h, w, o, _ = win.shingle_table()
            n = win.first_owner[w + 1] - win.first_owner[w]
            owner = np.repeat(win.first_owner[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = np.repeat(w, n)
            yield pa.record_batch(
                [
                    pa.array(np.repeat(h, n).view(np.int64)),
                    pa.array(np.repeat(o, n), pa.int32()),
                    pa.array(win.m[w], pa.int32()),
                    pa.array([win.text[x, : win.size[x]].tobytes() for x in w], pa.binary()),
                    pa.array(win.owners[owner].tolist(), pa.int64()),
                ],
                names=["h", "o", "m", "words", "item_id"],
            )

    def of_docs(batches):
        for part, data, off in sliced(batches):
            words, counts = S.word_hashes(data, off, S.ALNUM)
            ends = np.cumsum(counts)
            end_of, row_of = np.repeat(ends, counts), np.repeat(np.arange(len(counts)), counts)
            for k in ks:
                at = np.flatnonzero(np.arange(len(words)) + k <= end_of)
                row = row_of[at]
                yield pa.record_batch(
                    [
                        pa.array(S.folded(words, at, k).view(np.int64)),
                        part.column("doc_id").take(pa.array(row)),
                        part.column("t").take(pa.array(row)),
                        pa.array(at - (ends - counts)[row], pa.int32()),
                        pa.array(counts[row], pa.int32()),
                    ],
                    names=["h", "doc_id", "t", "at", "n"],
                )

    keyed = docs.withColumn("t", F.xxhash64("text"))
    sized = stored(items.where(F.col("text").isNotNull()).mapInArrow(of_items, "h long, o int, m int, words binary, item_id long"), "windows")
    wanted = sized.select("h").distinct()
    length = F.least(F.octet_length("words") / 8, F.lit(shingle)).cast("int")
    ks = sorted(r[0] for r in sized.select(length).distinct().collect())  # at most `shingle` values
    met = stored(keyed.mapInArrow(of_docs, "h long, doc_id long, t long, at int, n int").join(wanted, "h", "left_semi"), "met")
    df = met.select("h", "doc_id", "t").distinct().groupBy("h").agg(F.count("*").alias("df"))
    shingle_of = sized.select("words", "m", "h", "o").distinct()
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "o")))
    need = F.greatest(F.lit(1), F.ceil(F.lit(containment) * F.col("m") - F.lit(1e-9)).cast("int"))
    prefix = (
        shingle_of.join(df, "h", "left")
        .groupBy("words", "m")
        .agg(order.alias("s"))  # at most `window` shingles
        .select("words", F.explode(F.slice("s", F.lit(1), F.col("m") - need + 1)).alias("p"))
        .where("p.df > 0")
        .select("words", "p.h", "p.o")
    )
    size = (F.octet_length("words") / 8).cast("int")
    begun = (
        met.join(prefix, "h")
        .withColumn("begin", F.col("at") - F.col("o"))
        .where((F.col("begin") >= 0) & (F.col("begin") + size <= F.col("n")))
        .select("doc_id", "t", "begin", "words")
        .distinct()
    )
    ids = sized.select("words", "item_id").distinct()
    per_doc = (
        begun.join(ids, "words")
        .groupBy("doc_id", "t")  # within one document
        .agg(F.collect_list(F.struct("begin", "words", "item_id")).alias("found"))
        .withColumnRenamed("doc_id", "d2")
        .withColumnRenamed("t", "t2")
    )
    both = keyed.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left")

    def judge(batches):
        for batch in batches:
            data, off = text_buffers(batch.column("text")) if batch.num_rows else (None, None)
            hits, items, counts = [], [], []
            for i, found in enumerate(batch.column("found").to_pylist()):
                words, n = S.word_hashes(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), S.ALNUM)
                hit, mine = np.zeros(len(words), bool), set()
                for f in found or ():
                    text = np.frombuffer(f["words"], np.uint64)
                    k = min(shingle, len(text))
                    same = words[f["begin"] : f["begin"] + len(text)] == text
                    equal = sum(bool(same[j : j + k].all()) for j in range(len(text) - k + 1))
                    if equal >= int(_ceil_share(containment, np.array([len(text) - k + 1]))[0]):
                        hit[f["begin"] : f["begin"] + len(text)] = True
                        mine.add(f["item_id"])
                hits.append(int(hit.sum()))
                items.append(sorted(mine, key=lambda v: (v is None, v)))
                counts.append(int(n[0]))
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("t"),
                    pa.array(counts, pa.int64()),
                    pa.array(hits, pa.int64()),
                    pa.array(items, pa.list_(pa.int64())),
                ],
                names=["doc_id", "t", "n_words", "n_hit", "items"],
            )

    schema = "doc_id long, t long, n_words long, n_hit long, items array<long>"
    out = both.select("doc_id", "t", "text", "found").mapInArrow(judge, schema)
    return out if with_hash else out.drop("t")


def digest(found: DataFrame, share: tuple[int, int] = (1, 20)) -> DataFrame:
    """Adds ``n_items``, ``items_sha256`` (of the ids sorted as strings, joined by commas) and
    ``contaminated``: some word is hit, and at least ``share`` of all words."""
    names = F.array_sort(F.transform(F.filter("items", lambda i: i.isNotNull()), lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        _contaminated("", share).alias("contaminated"),
    )


def _contaminated(of: str, share: tuple[int, int]):
    hit, words = F.col(of + "n_hit"), F.col(of + "n_words")
    return (hit > 0) & (share[1] * hit >= share[0] * words)


def clean(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    shingle: int = 5,
    containment: float = 1.0,
    share: tuple[int, int] = (1, 20),
    broadcast_bytes: int = 32_000_000,
) -> DataFrame:
    """``docs`` without the contaminated ones (see ``matches`` and ``digest``), with their own columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    if _small(items, broadcast_bytes):
        found = _finder(docs.select("text"), items, window, shingle, containment)(F.col("text"))
        judged = docs.select(F.struct(*columns).alias("__d"), found.alias("__m"))
        return judged.where(~_contaminated("__m.", share)).select("__d.*")
    keyed = docs.select(F.struct(*columns).alias("__d"), "doc_id", "text").withColumn("t", F.xxhash64("text"))
    found = _matches_large(
        keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, window, shingle, containment, True
    )
    bad = found.where(_contaminated("", share)).select(F.col("doc_id").alias("d2"), F.col("t").alias("t2"))
    same = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2"))
    return keyed.join(bad, same, "left_anti").select("__d.*")
