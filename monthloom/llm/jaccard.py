"""All links between texts whose word-shingle sets have a high Jaccard similarity.

Sets are ordered by rarity of their shingles.  Of two similar sets the first ``n - need + 1``
shingles (the prefix) have one in common, and a prefix that is ``g`` longer has ``g + 1``.  Rare
shingles of the prefix are indexed singly.  Where the first common shingle is a frequent one, so
are the next ``g``; frequent shingles fall into ``g`` classes by their hash, two of ``g + 1``
fall into one class, and so pairs of frequent shingles of one class are indexed over the longer
prefix.  Sets that meet in the index are compared whole.

What keeps this linear where a group is large:

* equal sets are one set from the start;
* a set with too many shingles that no other set has cannot be similar to any; these, nearly all
  of a normal corpus, are found from a quarter of the shingles and go before the index;
* within an index entry only the links that matter for components are sought: all members are
  compared with a central one, and those not linked to it with the members of other components that
  size, place in the order and parity bits leave possible.

Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm import shingles as S
from monthloom.llm.common import carried, row_slices, sliced, stored
from monthloom.llm.components import components

#: Sets up to this size are screened by all their shingles, larger ones by a quarter.
SCREENED_WHOLE = 256
QUARTER = 3
#: Bits of the filter of documents that passed the screen: 8 MB whatever the table's size.
FILTER_BITS = 1 << 26
#: Text, and entries of the index, that a task turns into arrays at a time.
SET_BYTES = 1_000_000
SET_ENTRIES = 100_000
#: Words of 64 parity bits that bound from below in how many shingles two sets differ.
PARITY_WORDS = 8
#: A shingle in more sets than this (of about equal size, after the screen) is frequent.
FREQUENT = 256


class Rule:
    """``similar``: 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        if not 50 < percent <= 100:
            raise ValueError("percent must be over 50 and at most 100")
        self.percent = percent

    def need(self, n):
        """Least overlap of a set of ``n`` with any similar one."""
        return -(-self.percent * n // 100)

    def prefix(self, n):
        return n - self.need(n) + 1

    def largest_partner(self, n, overlap):
        """The largest size a partner can have that shares at most ``overlap``."""
        return (100 + self.percent) * overlap // self.percent - n

    def classes(self, band):
        """Classes of frequent shingles for sets of 2^band up to 2^(band + 1)."""
        return max(1, self.prefix((2 << band) - 1) // 4)


def _sets(data, off, shingle):
    """Distinct shingle hashes of some rows in order, their number per row, and a digest of each set."""
    words, counts = S.word_hashes(data, off, S.SPACED)
    h, n = S.distinct(*S.shingles(words, counts, shingle), len(counts))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(S.mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    ends = np.cumsum(n)
    return h, n, S.mix(sums[ends] - sums[ends - n] + n.astype(np.uint64))


def _lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(values.view(np.int64)))


def _parity(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per row: for each of 64 * PARITY_WORDS classes of hashes whether the set has an odd number of them.

    A shingle that only one of two sets has turns one bit, so sets differ in at least as many
    shingles as their parities differ in bits.
    """
    at = (S.mix(h ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * PARITY_WORDS)).astype(np.int64)
    out = np.zeros((len(n), PARITY_WORDS), np.uint64)
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(n)), n), at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def sized(docs: DataFrame, shingle: int, rule: Rule) -> DataFrame:
    """``doc_id``, ``t`` (hash of the text), ``n``, ``dg`` and the shingles the screen uses, per row of ``docs``."""
    whole = SCREENED_WHOLE * 100 // rule.percent + 1  # sizes that can be similar to one screened whole

    def run(batches):
        for part, data, off in sliced(batches, limit=SET_BYTES):
            h, n, dg = _sets(data, off, shingle)
            keep = ((h & np.uint64(QUARTER)) == 0) | np.repeat(n <= whole, n)
            kept = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
            yield pa.record_batch(
                [part.column("doc_id"), part.column("t"), pa.array(n), pa.array(dg.view(np.int64)), _lists(h[keep], kept)],
                names=["doc_id", "t", "n", "dg", "some"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    return rows.mapInArrow(run, "doc_id long, t long, n long, dg long, some array<long>")


def screened(sets: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The classes that can be similar to another: not too many of their shingles are theirs alone."""
    owners = (
        sets.where("n > 0")
        .select("dg", F.explode("some").alias("s"))
        .groupBy("s")
        .agg(F.min("dg").alias("dg"), F.max("dg").alias("other"))
    )
    alone = (
        owners.where("dg = other")
        .groupBy("dg")
        .agg(F.count("*").alias("all"), F.count_if(F.col("s").bitwiseAND(QUARTER) == 0).alias("quarter"))
    )
    own = F.coalesce(F.when(F.col("n") <= SCREENED_WHOLE, F.col("all")).otherwise(F.col("quarter")), F.lit(0))
    need = F.expr(f"({rule.percent} * n + 99) div 100")
    return classes.join(alone, "dg", "left").where(own <= F.col("n") - need).select("dg", "n", "rep")


def _filter_of(keys: DataFrame) -> np.ndarray:
    """Bits set for ``p`` (0 up to FILTER_BITS) of all rows; built where the rows are, of fixed size."""
    per_bucket = 32_768
    rows = (
        keys.select(F.shiftright("p", 15).alias("bucket"), F.col("p").bitwiseAND(per_bucket - 1).alias("at"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
        .collect()  # FILTER_BITS / 32768 rows of 4 KB at most
    )
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r["bucket"] * per_bucket // 8 :][: per_bucket // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _place(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS))


def full_sets(docs: DataFrame, chosen: DataFrame, shingle: int) -> DataFrame:
    """``dg``, ``n``, all ``shingles`` and their ``parity`` of the chosen classes.

    Documents pass a filter of fixed size by their id before they are read, then a join decides, so
    texts are not shuffled.
    """
    spark = docs.sparkSession
    bits = carried(spark, _filter_of(chosen.select(_place(F.col("rep")).alias("p"))))

    def run(batches):
        known = bits()
        for batch in batches:
            p = batch.column("p").to_numpy()
            batch = batch.filter(pa.array((known[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))
            for part, data, off in sliced([batch], limit=SET_BYTES):
                h, n, dg = _sets(data, off, shingle)
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array(dg.view(np.int64)),
                        pa.array(n),
                        _lists(h, n),
                        _lists(_parity(h, n).reshape(-1), np.full(len(n), PARITY_WORDS)),
                    ],
                    names=["id", "dg", "n", "shingles", "parity"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("p", _place(F.col("doc_id")))
    found = rows.mapInArrow(run, "id long, dg long, n long, shingles array<long>, parity array<long>")
    c = chosen.select(F.col("dg").alias("dg2"), "rep")
    # rows that repeat id and text have one set
    return (
        found.join(c, (F.col("dg") == F.col("dg2")) & F.col("id").eqNullSafe(F.col("rep")), "left_semi")
        .groupBy("dg")
        .agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.first("parity").alias("parity"))
    )


def index(sets: DataFrame, rule: Rule, frequent: int) -> DataFrame:
    """Index entries ``key``, ``dg``, ``n``, ``overlap`` (what the set can share with one first met here) and ``largest``
    (partner)."""
    # every two sizes that can be similar have a band in common: that of the larger
    home = F.length(F.bin("n")) - 1
    edge = F.expr(f"{rule.percent} * shiftleft(2L, length(bin(n)) - 1)")
    bands = F.when(100 * F.col("n") >= edge, F.array(home, home + 1)).otherwise(F.array(home))
    tokens = sets.select("dg", "n", F.explode(bands).alias("band"), "shingles").select(
        "dg", "n", "band", F.explode("shingles").alias("s")
    )
    df = tokens.groupBy("band", "s").agg(F.count("*").alias("c")).where("c > 1")
    shared = (
        tokens.join(df, ["band", "s"])
        .groupBy("dg", "n", "band")  # within one set
        .agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("shared"))
    )

    def parts(batches):
        for batch in batches:
            for a, b in row_slices(batch.column("shared").offsets.to_numpy(), SET_ENTRIES):
                yield batch.slice(a, b - a)

    def run(batches):
        for batch in parts(batches):
            out: dict[str, list] = {k: [] for k in ("key", "dg", "n", "overlap")}
            lists = batch.column("shared")
            flat, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            counts, hashes = flat.field("c").to_numpy(), flat.field("s").to_numpy().view(np.uint64)
            rows = zip(*(batch.column(c).to_pylist() for c in ("dg", "n", "band")), bounds[:-1], bounds[1:], strict=True)
            for dg, n, band, a, b in rows:
                own = n - (b - a)  # shingles no other set of the band has come first
                p, g = rule.prefix(n), rule.classes(band)
                ranks = own + 1 + np.arange(b - a)
                rare = counts[a:b] <= frequent
                one = rare & (ranks <= p)
                h = hashes[a:b]
                keys = [S.mix(h[one] ^ np.uint64(band + 1))]
                bound = [n - ranks[one] + 1]
                many = np.flatnonzero(~rare & (ranks <= p + g))
                if len(many) > 1 and own < p:
                    kind = h[many] % np.uint64(g)
                    order = np.argsort(kind, kind="stable")
                    for members in np.split(many[order], np.flatnonzero(np.diff(kind[order])) + 1):
                        x, y = np.triu_indices(len(members), 1)
                        x, y = members[x], members[y]
                        keys.append(S.mix(S.mix(h[x]) * np.uint64(3) + h[y] + np.uint64(band + 1)))
                        # before the first of the two up to g - 1 shingles may be common
                        bound.append(n - np.maximum(own + 1, ranks[x] - g + 1) + 1)
                keys, bound = np.concatenate(keys), np.concatenate(bound)
                out["key"].append(keys)
                out["overlap"].append(bound)
                out["dg"].append(np.full(len(keys), dg))
                out["n"].append(np.full(len(keys), n))
            if out["key"]:
                joined = {k: np.concatenate(v) for k, v in out.items()}
                yield pa.record_batch(
                    [pa.array(joined["key"].view(np.int64)), *[pa.array(joined[k].astype(np.int64)) for k in ("dg", "n", "overlap")]],
                    names=["key", "dg", "n", "overlap"],
                )

    entries = shared.mapInArrow(run, "key long, dg long, n long, overlap long")
    return entries.withColumn("largest", F.expr(f"{100 + rule.percent} * overlap div {rule.percent} - n")).where(
        f"100 * largest >= {rule.percent} * n"
    )


def _may_match(x: str, y: str, percent: int) -> Column:
    """Sizes of the two allow it, and each is small enough for what the other can share."""
    return F.expr(
        f"{x}.n <= {y}.largest and {y}.n <= {x}.largest and "
        f"100 * {x}.n >= {percent} * {y}.n and 100 * {y}.n >= {percent} * {x}.n"
    )


def _parity_allows(x: str, y: str, percent: int) -> Column:
    """The sets differ in few enough shingles, as far as their parities tell."""
    differ = " + ".join(f"bit_count({x}.p{k} ^ {y}.p{k})" for k in range(PARITY_WORDS))
    return F.expr(f"{100 + percent} * ({x}.n + {y}.n - ({differ})) >= {2 * percent} * ({x}.n + {y}.n)")


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) that are similar."""
    a = sets.select(F.col("dg").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("dg").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"))
        .where(f"100 * i >= {rule.percent} * (na + nb - i)")
        .select("a", "b")
    )


def _labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return entries.withColumn("component", F.col("dg"))
    return entries.join(labels, F.col("dg") == F.col("node"), "left").select(
        *entries.columns, F.coalesce("component", F.col("dg")).alias("component")
    )


def _unsettled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries with ``component``, of keys that still hold several, and that have a possible partner there."""
    e = _labelled(entries, labels)
    per_key = e.groupBy("key").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("n").alias("least")
    )
    return e.join(per_key.where("c0 <> c1"), "key").where("largest >= least").select(*entries.columns, "component")


def links(entries: DataFrame, sets: DataFrame, rule: Rule, rounds: int = 2) -> tuple[DataFrame, DataFrame | None]:
    """Links enough for the components of all similar pairs, and the components' labels (None: no link).

    In a round the members of a key that are of another component than its central member
    (the one that can share most) are compared with it; a second round takes a centre among those
    that were not linked.  Then every member outside the centre's component is compared with
    all possible partners of other components, so that no link between components is lost.
    """
    spark = sets.sparkSession
    done = spark.createDataFrame([], "a long, b long")
    found, labels = done, None

    def settle(pairs):
        nonlocal done, found, labels
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return
        new = stored(verified(pairs, sets, rule), "similar")
        done = done.unionByName(pairs)
        if not new.isEmpty():
            found = found.unionByName(new)
            labels = components(found)

    def centres(e):
        centre = e.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("overlap")).alias("rank"), "dg", "n", "largest", "component")).alias("c"))
        return centre.select("key", F.struct("c.dg", "c.n", "c.largest", "c.component").alias("c"))

    remaining = entries
    for turn in range(rounds):
        e = stored(_unsettled(remaining, labels), "entries")
        if e.isEmpty():
            return found, labels
        star = e.join(centres(e), "key").withColumn("x", F.struct("n", "largest"))
        settle(
            star.where("component <> c.component").where(_may_match("x", "c", rule.percent)).select(F.col("c.dg").alias("a"), F.col("dg").alias("b"))
        )
        if turn + 1 < rounds:
            # those not linked to the centre choose one of their own
            e = _labelled(e.drop("component"), labels)
            away = e.join(centres(e), "key").where("component <> c.component")
            remaining = away.select(*entries.columns)
    e = stored(_unsettled(entries, labels), "entries")
    if e.isEmpty():
        return found, labels
    parity = sets.select(F.col("dg").alias("dg2"), *[F.col("parity")[k].alias(f"p{k}") for k in range(PARITY_WORDS)])
    e = stored(e.join(parity, F.col("dg") == F.col("dg2")).drop("dg2"), "entries")
    member = F.struct("dg", "n", "largest", "component", *[f"p{k}" for k in range(PARITY_WORDS)])
    away = e.join(centres(e), "key").where("component <> c.component").select("key", member.alias("x"))
    rest = away.join(e.select("key", member.alias("y")), "key").where(
        (F.col("x.component") != F.col("y.component"))
        & _may_match("x", "y", rule.percent)
        & _parity_allows("x", "y", rule.percent)
    )
    settle(rest.select(F.col("x.dg").alias("a"), F.col("y.dg").alias("b")))
    return found, labels


def grouped(docs: DataFrame, shingle: int = 4, percent: int = 85, frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``t`` (hash of the text), ``n_shingles``, ``component_id`` and ``component`` (a number
    of the component, null without shingles).

    Words are runs of anything but ASCII white space, A-Z lowered; a text of fewer words than
    ``shingle`` is one shingle as a whole.  Two texts are linked if 100 * intersection >=
    ``percent`` * union of their shingle sets; ``component_id`` is the smallest id reachable over links.  A
    null or empty text, or one without words, has no shingles and is linked with nothing.  Rows
    with null ids take part; a component of null ids only has a null ``component_id``.
    """
    rule = Rule(percent)
    sets = stored(sized(docs, shingle, rule), "sets")
    # copies of a set are one class from here on
    classes = sets.where("n > 0").groupBy("dg").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"))
    chosen = stored(screened(sets, classes, rule), "chosen")
    full = stored(full_sets(docs, chosen, shingle), "full")
    entries = stored(index(full, rule, frequent), "index")
    _, labels = links(entries, full, rule)
    own = sets.select("doc_id", "t", "n", F.when(F.col("n") > 0, F.col("dg")).alias("dg"))
    if labels is None:
        first = classes.select(F.col("dg").alias("dg2"), F.col("dg").alias("component"), F.col("rep").alias("component_id"))
    else:
        with_label = classes.join(labels, F.col("dg") == F.col("node"), "left").select(
            "dg", "rep", F.coalesce("component", F.col("dg")).alias("component")
        )
        of_component = with_label.groupBy("component").agg(F.min("rep").alias("component_id"))
        first = with_label.join(of_component, "component").select(F.col("dg").alias("dg2"), "component", "component_id")
    return own.join(first, F.col("dg") == F.col("dg2"), "left").select(
        "doc_id",
        "t",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "component",
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id.

    Where rows repeat id and text one of them stays; of different texts of one component under one id,
    the one with the smallest text hash.  Texts without shingles all stay.  A component of null ids
    keeps the text with the smallest hash.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    g = stored(grouped(docs, **options), "grouped")
    some = g.where("n_shingles > 0")
    best = some.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "t")).alias("k"))
    empty = g.where("n_shingles = 0").select("doc_id", "t").distinct()
    keep = stored(best.select("k.doc_id", "k.t").unionByName(empty), "kept")
    k = keep.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
    body = docs.select(F.struct(*columns).alias("__d"), F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__h"))
    kept = body.join(k, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__t")), "left_semi")
    if not some.groupBy("doc_id", "t").count().where("count > 1").isEmpty():
        words = F.coalesce(F.col("__d.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        kept = kept.where(~words).unionByName(kept.where(words).dropDuplicates(["__doc", "__h"]))
    return kept.select("__d.*")
