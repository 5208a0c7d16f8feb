"""Language of a text by compression: the language whose sample shortens it most.

Each language is a stretch of its own text, given to zstandard as a raw-content dictionary.
A text is encoded once per language, piece by piece so that a long text cannot become its own
dictionary, and the smallest total wins.  The lead over the second is the margin.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from monthloom.llm.common import row_slices, text_buffers

UNDETERMINED = "und"
#: Rows of a language are first ranked in so many parts, so that no task ranks more than their best.
PARTS = 16
#: Text taken from a batch at a time.
TEXT_BYTES = 1_000_000
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def learn(
    labelled: DataFrame,
    sample_bytes: int = 131_072,
    sample_rows: int = 512,
    piece_chars: int = 400,
) -> dict[str, bytes]:
    """A raw-content dictionary per value of ``lang``, from rows with ``text`` and ``lang``.

    The sample is bounded by the parameters: ``sample_rows`` rows per language, in the order of
    a hash of the text, give ``piece_chars`` characters each, from a place that the same hash
    names, up to ``sample_bytes``.  Repeated texts are used once: copies become one row, by a partial
    aggregate, before the row limit.  The limit is applied to parts of a language by the hash, then to
    what they leave, so the last ranking sees ``PARTS`` times ``sample_rows`` rows whatever the
    table's size.  Rows without text or language teach nothing.
    """
    # only a short piece of each text takes part in the ranking
    room = F.greatest(F.length("text") - F.lit(piece_chars), F.lit(0)) + 1
    place = F.pmod(F.xxhash64("text"), room).cast("int") + 1
    ranked = (
        labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .select(
            F.col("lang").alias("__l"),
            F.xxhash64("text").alias("__h"),
            F.substr(F.col("text"), place, F.lit(piece_chars)).alias("__p"),
        )
        .groupBy("__l", "__h")
        .agg(F.min("__p").alias("__p"))
        .withColumn("__b", F.pmod("__h", F.lit(PARTS)))
        .withColumn("__r", F.row_number().over(Window.partitionBy("__l", "__b").orderBy("__h", "__p")))
        .where(F.col("__r") <= sample_rows)
        .withColumn("__r", F.row_number().over(Window.partitionBy("__l").orderBy("__h", "__p")))
        .where(F.col("__r") <= sample_rows)
        .withColumn("__p", F.trim(F.regexp_replace(F.lower("__p"), r"[^\p{L}]+", " ")))
    )
    pieces: dict[str, list[str]] = {}
    for row in ranked.select("__l", "__r", "__p").collect():  # sample_rows per language
        pieces.setdefault(row["__l"], []).append((row["__r"], row["__p"]))
    out = {}
    for lang, found in sorted(pieces.items()):
        joined = " ".join(p for p in dict.fromkeys(p for _, p in sorted(found)) if p)
        out[lang] = joined.encode()[-sample_bytes:]
    return out


def _encoders(dictionaries: dict[str, bytes], level: int):
    import zstandard

    out = []
    for lang, raw in sorted(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        if len(raw) >= 8:
            d.precompute_compress(level=level)
        out.append(
            (lang, zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_dict_id=False))
        )
    return out


def classify(text: str | None, encoders, piece_bytes: int) -> tuple[str, float, float, int]:
    """(language, score, margin, bytes encoded) of one text."""
    letters = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not any(map(str.isalpha, letters)) or not encoders:
        return UNDETERMINED, 0.0, 0.0, 0
    raw = letters.encode("utf-8", "replace")
    sizes = [sum(len(z.compress(raw[i : i + piece_bytes])) for i in range(0, len(raw), piece_bytes)) for _, z in encoders]
    order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
    best = sizes[order[0]]
    second = sizes[order[1]] if len(order) > 1 else best + len(raw)
    lead = second - best
    return encoders[order[0]][0], float(1 - 0.5 ** (1 + lead / 4)), lead / max(second, 1), len(raw)


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    level: int = 3,
    piece_bytes: int = 4096,
    min_margin: float = 0.005,
    min_bytes: int = 200,
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``margin`` and ``rejected`` added (replacing equal names).

    ``lang_pred`` is a learned language, or ``und`` where the text is null or has no letter.
    ``score`` runs from 0.5 for a tie towards 1 as the lead in bytes grows (0 for ``und``).
    ``rejected`` is true for ``und`` and where the lead is below ``min_margin`` of the second size
    although at least ``min_bytes`` were encoded: shorter texts differ by too few bytes for a
    narrow lead to say anything, so they keep their best language.  Ties go to the language
    first in alphabetical order.  The whole text is encoded.  An empty table stays empty.
    """
    learned = dict(dictionaries)  # bounded by learn(): travels with the function

    encoders: list = []

    @F.arrow_udf("struct<lang_pred:string,score:double,margin:double,encoded:int>")
    def judge(column: pa.Array) -> pa.Array:
        if not encoders:  # once per task
            encoders.extend(_encoders(learned, level))
        rows = []
        for a, b in row_slices(text_buffers(column)[1], TEXT_BYTES):
            rows += [classify(t, encoders, piece_bytes) for t in column.slice(a, b - a).to_pylist()]
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.int32())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "margin", "encoded"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "margin", "rejected")]
    judged = docs.select(*[F.col(f"`{c}`") for c in kept], judge("text").alias("__judged"))
    narrow = (F.col("__judged.margin") < min_margin) & (F.col("__judged.encoded") >= min_bytes)
    return judged.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("__judged.lang_pred").alias("lang_pred"),
        F.col("__judged.score").alias("score"),
        F.col("__judged.margin").alias("margin"),
        (narrow | (F.col("__judged.lang_pred") == UNDETERMINED)).alias("rejected"),
    )


def fold_of(doc_id) -> F.Column:
    """The fourth of the documents a row belongs to, from its id written as text (null: 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))
