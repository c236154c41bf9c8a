"""Operator 5: language identification by multilingual mixture inference.

A language is a distribution over hashed byte trigrams of letters, estimated from labelled texts. A document is a mixture of languages and a
uniform rest: expectation-maximisation on its trigram counts gives the shares. The set of languages is the one with the best
likelihood less half the logarithm of the number of trigrams for each language beyond the first; sets are nested, in the order of the
shares. The prediction is the language with the largest share, the score that share.

Every document's whole text is used. The languages are learned from about ``train_docs`` labelled documents of each label (fewer where there
are fewer), taken by a hash; that bounds what the driver gathers and broadcasts: one vector of ``FEATURES`` single-precision numbers for each label, of which
there may be ``most_labels`` (more are an error: a table with so many labels has something else in that column).

Edge cases: a null text, and one without a letter, is ``und`` with score 0; so are all documents if there is no labelled text. Ties go to the
label that sorts first. Repeated rows are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import bounded_batches, fresh, lean, mapped
from textloom.llm.token_counts import slices

BITS = 14
FEATURES = 1 << BITS
TRAIN_DOCS = 2000
SMOOTHING = 0.1
ROUNDS = 12
SLICE_BYTES = 1 << 20
LEAST_SHARE = 0.02
MOST_LABELS = 4000

LETTER = np.full(256, 32, np.uint8)  # anything that is no letter counts as a blank
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts of a slice without nulls, and where each text's begin. A text has a blank at both ends."""
    texts = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = LETTER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]].astype(np.uint32)
    offsets = offsets - offsets[0]
    before = np.empty_like(data)  # each text ends with a blank, so the one before a text is there too
    before[1:], before[:1] = data[:-1], 32
    after = np.empty_like(data)
    after[:-1], after[-1:] = data[1:], 32
    code = (before << np.uint32(16)) | (data << np.uint32(8)) | after
    good = data != 32
    place = np.concatenate(([0], np.cumsum(good)))[offsets]
    return ((code[good] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32), place


def held_out(doc_id: Column, remainder: int = 1, of: int = 3) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == remainder, F.lit(False))


def learn(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", train_docs: int = TRAIN_DOCS, most_labels: int = MOST_LABELS) -> tuple[list[str], np.ndarray]:
    """The labels, in order, and the distributions of their features."""
    bounded_batches(labelled.sparkSession)
    own = labelled.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("label"))
    own = own.where("text is not null and label is not null and id is not null")
    found = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).limit(most_labels + 1).collect()}
    if len(found) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    if not found:
        return [], np.zeros((0, FEATURES), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in found.items() for x in (k, min(1.0, train_docs / n))])
    sample = own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("label")] * (1 << 30))
    rows = sample.select("label", "text").mapInArrow(counted, "label string, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    vectors = rows.groupBy("label").agg(F.collect_list("feature").alias("features"), F.collect_list("n").alias("counts"))  # one row a label, of FEATURES numbers at most
    labels = sorted(found)
    p = np.full((len(labels), FEATURES), SMOOTHING, np.float32)
    for r in vectors.toLocalIterator():
        p[labels.index(r.label), r.features] += np.array(r.counts, np.float32)
    for own in p:
        own /= own.sum(dtype=np.float64)
    return labels, p


@lean
def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        labels, texts = np.array(b["label"].to_pylist()), b["text"].cast(pa.large_string())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        for at, to in slices(sizes, SLICE_BYTES):
            codes, place = trigrams(texts.slice(at, to - at))
            for i in range(to - at):
                n = total.setdefault(labels[at + i], np.zeros(FEATURES, np.int64))
                n += np.bincount(codes[place[i] : place[i + 1]], minlength=FEATURES)
    for label, n in total.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([str(label)] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["label", "feature", "n"])


def shares(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares of the components with the probabilities p[component, feature] for counts n, and the log-likelihood."""
    total = n.sum()
    own = np.full(len(p), 1 / len(p))
    for _ in range(rounds):
        mixed = own @ p
        new = own * (p @ (n / mixed)) / total
        moved = np.abs(new - own).max()
        own = new
        if moved < 1e-3:
            break
    return own, float(n @ np.log(own @ p))


def infer(p: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Shares of the languages; the last row of ``p`` is the uniform rest."""
    n = np.bincount(codes, minlength=FEATURES)
    some = np.flatnonzero(n)
    n, p = n[some].astype(float), p[:, some].astype(float)
    own, _ = shares(p, n)
    languages = len(p) - 1
    order = np.argsort(-own[:languages], kind="stable")
    penalty = 0.5 * np.log(n.sum() + 1)
    best: tuple[float, np.ndarray] | None = None
    for m in range(1, languages + 1):
        if m > 1 and own[order[m - 1]] < LEAST_SHARE:
            break
        chosen = [*order[:m], languages]
        part, likelihood = shares(p[chosen], n)
        value = likelihood - penalty * (m - 1)
        if best is not None and value <= best[0]:
            break
        out = np.zeros(languages)
        out[order[:m]] = part[:m]
        best = (value, out)
    return best[1]


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``df`` (all, unless given) plus lang_pred, score and lang_shares (a map of the chosen languages).
    Columns with these names are replaced."""
    bounded_batches(df.sparkSession)
    labels, p = model
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType()))]
    names = [f.name for f in new]
    columns = [c for c in (df.columns if columns is None else columns) if c not in names]
    hidden = fresh("text", columns)
    own = df.select(*[F.col(f"`{c}`") for c in columns], F.when(F.col(f"`{text}`").cast("string").rlike(r"\p{L}"), F.col(f"`{text}`").cast("string")).alias(hidden))
    shared = df.sparkSession.sparkContext.broadcast((labels, np.vstack([p, np.full((1, FEATURES), 1 / FEATURES)]).astype(np.float32)))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, p = shared.value
        for b in batches:
            texts = b[hidden]
            known = texts.is_valid().to_numpy(zero_copy_only=False)
            texts = pc.fill_null(texts.cast(pa.large_string()), "")
            pred: list = ["und"] * len(texts)
            score, maps = np.zeros(len(texts)), [[] for _ in pred]
            if labels:
                for at, to in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
                    codes, place = trigrams(texts.slice(at, to - at))
                    for i in np.flatnonzero(known[at:to]):
                        own = infer(p, codes[place[i] : place[i + 1]])
                        k = int(own.argmax())
                        pred[at + i], score[at + i] = labels[k], min(1.0, own[k])
                        maps[at + i] = [(labels[x], float(own[x])) for x in np.flatnonzero(own)]
            made = {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score), "lang_shares": pa.array(maps, pa.map_(pa.string(), pa.float64()))}
            yield pa.RecordBatch.from_arrays([*[b[c] for c in columns], *made.values()], [*columns, *made])

    return mapped(own, run, T.StructType([*[df.schema[c] for c in columns], *new]))
