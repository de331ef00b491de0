"""Language identification by string kernels.

Texts are compared by a blended-spectrum presence kernel: the n-grams of 1 to 3 bytes that two texts share, normalised.
Landmark texts of each language give a Nyström map, and one-versus-rest kernel ridge regression is fitted on it from a
bounded sample. The kernel is linear in n-gram presence, so the landmarks' rows, the map and the regression multiply
out to one matrix, and a batch of texts is scored by one product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"

def has_letter(text: str) -> bool:
    """Whether any character is a letter; the pattern also finds number signs such as a half, which are none."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


#: Bytes as classes: a-z and A-Z alike, each byte above 127 one of its own, all else one class.
CLASSES = 1 + 26 + 128


def classes() -> bytes:
    """The class of each byte: 0 for white space, digits and signs; 1 to 26 letters; from 27 on the bytes of UTF-8."""
    table = bytearray(256)
    for k in range(26):
        table[65 + k] = table[97 + k] = 1 + k
    for b in range(128, 256):
        table[b] = 27 + b - 128
    return bytes(table)


TABLE = classes()


def grams(text: bytes) -> np.ndarray:
    """Codes of the n-grams of 1 to 3 classes in a whole text, with repeats."""
    c = np.frombuffer(b"\0" + text.translate(TABLE) + b"\0", np.uint8).astype(np.int32)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # a run of other characters is one
    one, two = c, c[:-1] * CLASSES + c[1:]
    three = two[:-1] * CLASSES + c[2:]
    return np.concatenate([one, two + CLASSES, three + CLASSES + CLASSES**2])


@dataclass
class KernelRidge:
    """The fitted model: which n-grams count, and what each adds to each language."""

    languages: list[str]
    index: np.ndarray  # code -> column, the last column for codes of no landmark
    weights: np.ndarray  # columns x languages

    def presence(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text over the landmarks' n-grams, scaled so that the row over all its n-grams has length 1."""
        beyond = len(self.weights)
        out, sizes = np.zeros((len(texts), beyond + 1), np.float32), np.zeros((len(texts), 1), np.float32)
        for row, size, t in zip(out, sizes, texts, strict=True):
            codes = grams(t)
            columns = self.index[codes]
            row[columns] = 1
            size[0] = row[:-1].sum() + len(np.unique(codes[columns == beyond]))
        return out[:, :-1] / np.sqrt(np.maximum(sizes, 1))

    def decide(self, texts: list[bytes]) -> np.ndarray:
        """The regressions' values, texts x languages."""
        return self.presence(texts) @ self.weights

    @classmethod
    def fit(cls, texts: list[bytes], languages: list[str], landmarks: int = 32, ridge: float = 1e-2) -> KernelRidge:
        """From labelled texts; the first ``landmarks`` of each language are landmarks."""
        names = sorted(set(languages))
        chosen = [i for name in names for i in [k for k, x in enumerate(languages) if x == name][:landmarks]]
        codes = np.unique(np.concatenate([np.unique(grams(texts[i])) for i in chosen] or [np.zeros(0, np.int32)]))
        index = np.full(CLASSES + CLASSES**2 + CLASSES**3, len(codes), np.int32)
        index[codes] = np.arange(len(codes), dtype=np.int32)
        model = cls(names, index, np.zeros((len(codes), len(names)), np.float32))
        if not names:
            return model
        marks = model.presence([texts[i] for i in chosen]).astype(np.float64)
        # Rows over all n-grams are wide, so only so many are made at a time.
        kernel = np.concatenate([model.presence(texts[at : at + 128]) @ marks.T for at in range(0, len(texts), 128)])
        among = marks @ marks.T
        values, vectors = np.linalg.eigh(among)  # the Nystroem map: kernel @ among ** -1/2
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        mapped = kernel @ root
        target = np.array([[1.0 if x == name else -1.0 for name in names] for x in languages])
        # Each language weighs the same, however many texts it has.
        weigh = np.array([1 / languages.count(x) for x in languages])[:, None] * len(languages) / len(names)
        alpha = np.linalg.solve(mapped.T @ (weigh * mapped) + ridge * len(languages) * np.eye(len(chosen)) / len(chosen), mapped.T @ (weigh * target))
        model.weights = (marks.T @ (root @ alpha)).astype(np.float32)
        return model


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id's decimal text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, a_language: int = 400, most_languages: int = 1000, **options) -> KernelRidge:
    """A model from documents that aren't held out and have a language and a letter.

    The sample is bounded: at most ``a_language`` documents of each language, those of the least hashes of id and length
    (equal hashes by id). More than ``most_languages`` languages are an error, as none may be left out. A language's documents never meet in one task: they
    are counted, and the count says below which hash enough of them lie. Their ids reach the driver first (some four
    times the sample at most), then the texts of the sample. Of rows with one id that of the least text counts; an empty table gives a model without
    languages.
    """
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.length("text")), 11) / float(1 << 53)  # 0 to 1
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), place.alias("place"))
    counts = rows.groupBy("lang").count().orderBy("lang").limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than most_languages = {most_languages} languages to learn")
    if not counts:
        return KernelRidge.fit([], [], **options)
    enough = 2 * a_language + 20  # are expected below the limit, so that none is as good as impossible
    below = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], 1.0 if r["count"] <= 2 * enough else enough / r["count"])))
    near = rows.where(F.col("place") < F.try_element_at(below, F.col("lang"))).orderBy("place").limit(2 * enough * len(counts)).collect()
    ids: list[tuple] = []
    for r in counts:
        of = sorted({(x["place"], x["doc_id"]) for x in near if x["lang"] == r["lang"]})[:a_language]
        ids += [(doc_id, r["lang"], rank) for rank, (_, doc_id) in enumerate(of)]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, lang string, rank int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    sample = texts.join(chosen, ["doc_id", "lang"]).groupBy("lang", "rank", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", "rank").collect()  # a row an id
    return KernelRidge.fit([bytes(r["text"]) for r in sample if r["text"]], [r["lang"] for r in sample if r["text"]], **options)


def predict(docs: DataFrame, model: KernelRidge, batch: int = 64) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``; only its text is looked at.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learned. Texts
    are read whole, however long. Of languages with equal values the first by name is predicted. Repeated rows are
    predicted alike, each counted; a null doc_id isn't held out; an empty table gives no rows. Other columns than
    ``doc_id`` and ``text`` are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the code table and landmarks alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                texts = b.column(2).to_pylist()
                names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                some = [i for i, t in enumerate(texts) if t and m.languages and has_letter(t)]
                for at in range(0, len(some), batch):
                    part = some[at : at + batch]
                    found = m.decide([texts[i].encode("utf-8", "surrogatepass") for i in part])
                    for i, row in zip(part, found, strict=True):
                        names[i] = m.languages[int(row.argmax())]
                        scores[i] = float(np.clip((row.max() + 1) / 2, 0, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the labelled documents of ``docs`` that aren't held out (see ``fit``), and predicts all of ``docs`` (see ``predict``)."""
    return predict(docs, fit(docs))
