"""Document probability summed over all segmentations into pieces of a fixed vocabulary."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import Block, word_blocks

#: Words are runs without these characters.
WORD = r"[^\x20\x09-\x0D]+"
_MARK = "▁"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none for a null text."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


@dataclass
class Vocabulary:
    """Natural logarithms of the pieces' probabilities; ``single`` of the 256 bytes' pieces; ``end`` of the end of a text."""

    pieces: dict[str, float]
    single: list[float]
    end: float

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=0)

    def log_probability(self, word: str) -> float:
        """Forward recursion: the sum over all ways to write the marked word as pieces, bytes standing in for any character."""
        s = _MARK + word
        n, get, longest, exp, log = len(s), self.pieces.get, self.longest, math.exp, math.log
        sums = [0.0] + [0.0] * n
        for j in range(1, n + 1):
            spelled = 0.0
            for byte in s[j - 1].encode("utf-8", "replace"):
                spelled += self.single[byte]
            ways = [sums[j - 1] + spelled]
            for i in range(max(0, j - longest), j):
                p = get(s[i:j])
                if p is not None:
                    ways.append(sums[i] + p)
            top = max(ways)
            sums[j] = top if len(ways) == 1 else top + log(sum([exp(w - top) for w in ways]))
        return sums[n]


def load_pieces(model_file: str) -> tuple[list[str], list[int], bytes]:
    """Pieces in order of their ids, ids of the 256 bytes' pieces, and the file's bytes."""
    import sentencepiece

    with open(model_file, "rb") as f:
        proto = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    pieces = ["" if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) else sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return pieces, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], proto


def score(docs: DataFrame, model_file: str, learn: Column, doc_id: str = "doc_id", text: str = "text", alpha: float = 0.5) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row, logarithms to base 10.

    ``learn`` tells, from columns of ``docs``, which rows are learned from. The model is the
    fixed vocabulary of ``model_file`` with a probability for each piece and for the end
    of a text: its smoothed share among the pieces into which the file's tokenizer cuts the
    learned words, each as often as it comes. (The file's own scores are ranks of merges,
    not probabilities.) ``score`` is the logarithm of the text's probability, summed over
    all segmentations of its words. ``base_score`` and the counts are those of whole
    words with additive smoothing. A null text counts as empty, which is an end alone;
    repeated rows stay; with nothing to learn from all counts are 0.

    Words are coded block by block, so each distinct word of a block is one row when it
    is counted, scored and sent back, however often it comes. A frequent word has at most
    one row for each block. Counts of pieces are bounded by the vocabulary.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    pieces, byte_pieces, proto = load_pieces(model_file)
    body = F.col(f"`{text}`").cast("string")
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), words_of(body).alias("words"), F.coalesce(learn, F.lit(False)).alias("learn"))

    def counted(block: Block) -> list:
        learned = np.repeat(np.asarray(block.extra["learn"], dtype=bool), block.lens)
        counts = np.bincount(block.codes[learned], minlength=len(block.words))
        return [block.words, pa.array(counts, pa.int64()), int(np.asarray(block.extra["learn"], dtype=bool).sum())]

    blocks = cut_lineage(word_blocks(slim, kind, "words array<string>, counts array<bigint>, learned bigint", counted, ("learn",)))
    entries = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).select("block", "code", "w.words", "w.counts")
    counts = cut_lineage(entries.groupBy("words").agg(F.sum("counts").alias("c")))

    totals = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = blocks.agg(F.coalesce(F.sum("learned"), F.lit(0)).alias("n")).first()["n"]
    tokens, distinct = totals["n"] + ends, totals["v"] + (ends > 0)

    def cut(batches):
        import sentencepiece

        sp, sums = sentencepiece.SentencePieceProcessor(model_proto=proto), np.zeros(len(pieces), np.int64)
        for b in batches:
            lists = sp.encode(b.column("words").to_pylist(), num_threads=1)
            lens = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter((x for y in lists for x in y), np.int64, int(lens.sum()))
            np.add.at(sums, ids, np.repeat(np.asarray(b.column("c")), lens))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], names=["piece", "n"])

    seen = np.zeros(len(pieces), np.int64)
    for r in counts.where("c > 0").mapInArrow(cut, "piece int, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        seen[r["piece"]] = r["n"]
    total = math.log(int(seen.sum()) + ends + alpha * (len(pieces) + 1))
    logs = np.log(seen + alpha) - total
    vocabulary = Vocabulary({p: float(x) for p, x in zip(pieces, logs) if p}, [float(logs[i]) for i in byte_pieces], math.log(ends + alpha) - total)

    def lattice(batches):
        for b in batches:
            found = [vocabulary.log_probability(w) / math.log(10) for w in b.column("words").to_pylist()]
            yield b.append_column("p", pa.array(found, pa.float64()))

    scored = counts.mapInArrow(lattice, "words string, c bigint, p double")
    back = entries.select(F.col("block").alias("of"), "code", "words").join(scored, "words").select(F.col("of").alias("block"), "code", "c", "p")
    bottom, end_score = tokens + alpha * (distinct + 1), vocabulary.end / math.log(10)
    end_base = math.log10((ends + alpha) / bottom)

    def sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        size = len(right)
        c, p = np.zeros(size), np.zeros(size)
        place = np.asarray(right.column("code"), dtype=np.int64)
        c[place], p[place] = np.asarray(right.column("c")), np.asarray(right.column("p"))
        each, known, parts = np.log10((c + alpha) / bottom), (c > 0).astype(float), []
        for i in range(len(left)):
            codes = np.frombuffer(left.column("codes")[i].as_py(), np.int32)
            lens = np.asarray(left.column("lens")[i].values, dtype=np.int64)
            at = np.concatenate([[0], np.cumsum(lens)])
            columns = (
                left.column("doc_ids")[i].values,
                pa.array(lens + 1),
                pa.array(_sums(known, codes, at).astype(np.int64) + int(ends > 0)),
                pa.array(np.full(len(lens), tokens, np.int64)),
                pa.array(_sums(each, codes, at) + end_base),
                pa.array(_sums(p, codes, at) + end_score),
            )
            parts.append(pa.table(list(columns), names=names))
        return pa.concat_tables(parts) if parts else pa.table({f: [] for f in names})

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    by_block = blocks.select(F.col("block").alias("own"), "doc_ids", "lens", "codes").groupBy("own").cogroup(back.groupBy("block"))
    return by_block.applyInArrow(sums, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _sums(values: np.ndarray, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the coded values between the places ``at``; each run is added up for itself, so long blocks lose no digits."""
    out = np.zeros(len(at) - 1)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(values[codes], at[:-1][full])
    return out
