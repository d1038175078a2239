"""Language identification by compression.

Each language has a zstandard raw-content dictionary: whole training texts of
that language, one after another. A text - its letters in lower case, everything
else one space - is compressed once with every dictionary, and the language with
the smallest result wins. The texts of a dictionary are chosen by hash, one for
each of ``slots`` slots of a language (an aggregation with bounded state), until
``dict_bytes`` are reached; a slot prefers texts of at most ``short`` characters,
so that a dictionary holds many texts, and takes a longer one where it has no
other, so that a language of long texts alone is learned too. Of a training text the
first ``dict_bytes`` characters are taken, so neither the aggregation nor the driver
holds more than ``slots`` times that of a language.

The score is the winner's share of the likelihoods 2**(-8 * size) of all
languages, tempered by ``temper``. A text is rejected (``rejected`` is true, the
best language still given) if the runner-up is nearer than ``min_margin`` of the
winner's size.

Defined results: a text that is null or has no letter is ``und`` with score 0; so
is every text if nothing can be learned. Equal sizes go to the language with most
training documents, then the first in code-point order. Null languages are not learned, nor are texts without
letters. Texts of any length are compressed whole. Repeated rows each get their
result, and count as often among the training documents. Other columns pass
through nowhere and never matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = 5
UNKNOWN = "und"
#: Lower-case ASCII letters and all bytes of other characters stay; the rest is a space.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def dictionaries(docs: DataFrame, slots: int = 96, dict_bytes: int = 96 << 10, short: int = 8000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """Raw dictionary content of each language, most frequent first."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rank = F.xxhash64(F.col(id_col), F.lit("language"))
    order = F.struct((F.length(text_col) > short).alias("long"), F.when(F.length(text_col) > short, F.length(text_col)).alias("length"), rank.alias("rank"), F.xxhash64(text_col).alias("same"))
    cells = usable.groupBy(F.col(lang_col).alias("lang"), F.pmod(rank, F.lit(slots)).alias("slot")).agg(F.min_by(F.substring(text_col, 1, dict_bytes), order).alias("text"))
    out: dict[str, list[bytes]] = {}
    for r in cells.orderBy("lang", "slot").toLocalIterator():
        have = out.setdefault(r["lang"], [])
        if sum(map(len, have)) < dict_bytes:
            have.append(folded(r["text"]))
    counts = {r["lang"]: r["count"] for r in docs.where(F.col(lang_col).isin(list(out))).groupBy(F.col(lang_col).alias("lang")).count().collect()} if out else {}
    return {lang: b" ".join(out[lang]) for lang in sorted(out, key=lambda x: (-counts[x], x))}


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(LETTERS).split())


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


class Compressors:
    """One compressor per language; made where it is used, as they cannot be sent."""

    def __init__(self, content: dict[str, bytes]):
        self.langs = list(content)
        self.made = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = folded(text)
        return [len(c.compress(data)) for c in self.made]


def identify(docs: DataFrame, content: dict[str, bytes], min_margin: float = 0.01, temper: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, lang_pred, score, margin, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(content)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def classified(batches):
        engines = Compressors(shared.value)
        for batch in batches:
            pred, score, margin, rejected = [], [], [], []
            for value in batch.column(1):
                text = value.as_py()
                if not engines.langs or not text or not has_letter(text):
                    pred.append(UNKNOWN), score.append(0.0), margin.append(0.0), rejected.append(True)
                    continue
                sizes = np.array(engines.sizes(text), float)
                best = int(sizes.argmin())
                others = np.delete(sizes, best)
                gap = float(others.min() - sizes[best]) if len(others) else float(sizes[best])
                pred.append(engines.langs[best])
                score.append(float(1 / np.exp2(-8 * temper * (sizes - sizes[best])).sum()))
                margin.append(gap / sizes[best])
                rejected.append(gap < min_margin * sizes[best])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "margin", "rejected"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(classified, f"id {kind}, lang_pred string, score double, margin double, rejected boolean").withColumnRenamed("id", id_col)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Learn from documents that are not held out; identify all."""
    content = dictionaries(docs.where(~held_out(id_col)), text_col=text_col, lang_col=lang_col, id_col=id_col)
    return identify(docs, content, id_col=id_col, text_col=text_col, **options).withColumn("held_out", held_out(id_col))
