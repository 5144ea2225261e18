"""Language identification by compression against per-language dictionaries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filter_texts, forget_caches, map_texts

#: Documents of a language in its dictionary, and bytes of each and of all.
SAMPLE_DOCS, DOC_BYTES, DICT_BYTES = 64, 8 << 10, 96 << 10
#: Compression level; lower ones look for longer matches only.
LEVEL = 6
#: Bytes of text compressed at a time, so that the dictionary tells all along a long text.
CHUNK = 4096
#: A text is rejected when the second-best language needs less than this share more bytes.
MARGIN = 0.005
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Raw-content dictionaries by language. Case is folded, so that words in capitals match them too."""

    dictionaries: dict[str, bytes]

    def classifier(self):
        """f(texts) -> language, score and margin of each text."""
        import zstandard as z

        forget_caches()
        names = sorted(self.dictionaries)
        each = []
        for name in names:
            d = z.ZstdCompressionDict(self.dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            each.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

        def one(text: str) -> tuple[str, float, float]:
            data = text.lower().encode("utf-8", "replace")
            sizes = np.zeros(len(each), np.int64)
            for i in range(0, len(data), CHUNK):
                piece = data[i : i + CHUNK]
                sizes += [len(c(piece)) for c in each]
            best = int(sizes.argmin())
            if len(each) == 1:
                return names[0], 1.0, 1.0
            second = int(np.partition(sizes, 1)[1])
            margin = (second - int(sizes[best])) / second
            # Code lengths as evidence, a bit counted a hundredth part, as the codes are far from ideal.
            score = 1.0 / np.exp2(np.maximum(-50.0, (sizes[best] - sizes) * 0.08)).sum()
            return names[best], float(score), margin

        def run(texts: pa.Array):
            letters = np.asarray(pc.match_substring_regex(texts, r"\pL"), dtype=bool)
            found = [one(t.as_py()) if ok and names else (UNKNOWN, 0.0, 0.0) for t, ok in zip(texts, letters)]
            return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]

        return run


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, max_languages: int = 1000) -> LanguageModel:
    """Dictionaries of the documents whose language isn't null.

    Each language gives the ``sample_docs`` documents whose ids have the smallest
    hashes, at most ``DOC_BYTES`` of each and ``DICT_BYTES`` of all: a bounded sample of its
    texts, which is all that the driver gathers. The documents share those bytes evenly, and
    what short ones leave goes to longer ones; a part begins anywhere in its text, as the id's hash says. Ids are picked on slim rows, each task keeping no more than the sample before the
    shuffle; repeated rows of an id take as many places and teach once.
    Rows with a null id, a null or empty text teach nothing; more than
    ``max_languages`` values of the language column are an error.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    known = slim.where("doc_id IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.select("doc_id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_docs)
    data, share = F.encode(F.lower("text"), "UTF-8"), max(1, DICT_BYTES // sample_docs)
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("data") - share, F.lit(0)) + 1).cast("int") + 1
    parts = F.substring(F.col("data"), start, F.lit(DOC_BYTES)).alias("part")
    rows = (
        known.select("doc_id", "lang", data.alias("data"))
        .select("doc_id", "lang", parts)
        .join(F.broadcast(picked.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi")
        .groupBy("doc_id", "lang")
        .agg(F.min("part").alias("part"))
        .limit(max_languages * sample_docs + 1)
        .collect()
    )
    found: dict[str, list[tuple]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append((r["doc_id"], bytes(r["part"])))
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages; is {lang} the language column?")
    return LanguageModel({k: b"\n".join(even_parts([p for _, p in sorted(v)], DICT_BYTES)) for k, v in found.items()})


def even_parts(parts: list[bytes], room: int) -> list[bytes]:
    """The parts, cut so that they fit in ``room`` bytes with a separator after each: all to one length, shorter ones whole."""
    room -= len(parts)
    most = 0
    for left, size in zip(range(len(parts), 0, -1), sorted(map(len, parts))):
        most = min(size, max(0, room) // left)
        room -= most
    return [p[:most] for p in parts]


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, margin, accepted) for each row.

    ``lang_pred`` is the language under whose dictionary the text takes fewest bytes (ties:
    the first by name); ``und`` with score 0 for a null text, one without a letter, or
    a model without languages. A margin below the limit is not accepted.
    """

    def make():
        f = model.classifier()

        def run(texts):
            lang, score, gap = f(texts)
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array([g >= margin for g in gap])]

        return run

    return map_texts(docs, doc_id, text, "lang_pred string, score double, margin double, accepted boolean", make)


def keep(docs: DataFrame, model: LanguageModel, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows, all columns unchanged, whose language is accepted; all rows if the model knows no language."""

    def make():
        if not model.dictionaries:
            return lambda texts: np.ones(len(texts), bool)
        f = model.classifier()
        return lambda texts: [g >= margin for g in f(texts)[2]]

    return filter_texts(docs, text, make)
