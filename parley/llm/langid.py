"""Language of a text: the nearest of several clustered centroids per language.

A text is a TF-IDF vector of hashed letter pairs and triples, of length 1. Document frequencies are counted over all
training rows. Each language gets up to ``CLUSTERS`` centroids by spherical k-means on at most ``SAMPLE`` of its training rows,
those of the smallest hash (the classifier's documented bound). A text takes the language of the centroid with the largest
cosine; it is marked as rejected if its distance is beyond what the training rows of that language show.

A null text or a text without a letter is ``und`` with score 0; nothing is learned from it. Rows with a null language teach
nothing. Without any training row, every text is ``und``. Equal texts get equal answers. Texts are read whole; other
columns are kept, and the result columns get an underscore in front if the table has such a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import blocks, bounded_batches, ddl, free_name
from .ngrams import hashed, symbols

BITS = 13
SAMPLE = 1500
CLUSTERS = 4
ROUNDS = 8
SHARPNESS = 30.0
PARTS = 32  # tasks that share a sample, which is bounded
UNKNOWN = "und"


def counts(texts, bits: int = BITS):
    """A row of n-gram counts per text, and whether it has letters."""
    import numpy as np

    sym, owner, has = symbols(texts)
    out = np.zeros(len(texts) << bits, np.float32)
    for order in (2, 3):
        code, whose = hashed(sym, owner, order, bits)
        out += np.bincount((whose << bits) + code, minlength=len(out))
    return out.reshape(len(texts), 1 << bits), has


def vectors(texts, idf):
    """Unit TF-IDF vectors (zero if nothing is known), and whether the texts have letters."""
    import numpy as np

    x, has = counts(texts)
    seen = x > 0
    x[seen] = 1 + np.log(x[seen])
    x *= idf
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    np.divide(x, length, out=x, where=length > 0)
    return x, has


def document_frequencies(docs: DataFrame, text: str = "text"):
    """Number of texts, and of texts with each n-gram, over all rows; the result has 2^BITS numbers."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for b in blocks(batches, text, rows=256):
            x, has = counts(b.column(b.schema.get_field_index(text)).to_pylist())
            seen += (x > 0).sum(axis=0)
            n += int(has.sum())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], names=["gram", "n"])

    rows = docs.select(text).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    found = {r["gram"]: r["n"] for r in rows}
    return found.get(-1, 0), np.array([found.get(g, 0) for g in range(1 << BITS)], np.float64)


def smallest(rows: DataFrame, label: str, most: int) -> DataFrame:
    """The ``most`` smallest hashes ``_h`` of every label. Only hashes that can be among them are sorted.

    The labels are those of a classifier, so a table with one row for each is small.
    """
    number = F.broadcast(rows.groupBy(label).agg(F.approx_count_distinct("_h").alias("_all")))
    share = F.least(F.lit(1.0), F.lit(2.0 * most + 200) / F.col("_all"))  # the count is within a few hundredths
    near = rows.select(label, "_h").join(number, label).filter((F.col("_h") / F.lit(2.0 ** 64) + 0.5) <= share)
    place = F.row_number().over(Window.partitionBy(label).orderBy("_h"))
    return near.select(label, "_h").distinct().withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def texts_of(docs: DataFrame, key: str, text: str, label: str, chosen: DataFrame) -> DataFrame:
    """The label, text and hash of the rows whose hash of key and text is in ``chosen``; rows that repeat count once.

    ``chosen`` holds a bounded number of hashes per label, so it is broadcast and the texts of all others stay in place.
    """
    hashed_docs = docs.filter(F.col(text).isNotNull()).select(text, F.xxhash64(key, text).alias("_h"))
    found = hashed_docs.join(F.broadcast(chosen), "_h").repartition(PARTS, "_h")
    return cut_lineage(found.dropDuplicates([label, "_h"]).select(label, text, "_h"))


def sample(docs: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """At most ``most`` rows per label, those of the smallest hash of key and text; rows that repeat count once."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(label, F.xxhash64(key, text).alias("_h"))
    return texts_of(docs, key, text, label, cut_lineage(smallest(rows, label, most)))


def cluster(x):
    """Unit centroids of the rows of ``x`` by spherical k-means, started from rows far from each other."""
    import numpy as np

    centres = [x.sum(axis=0)]
    centres[0] /= max(1e-9, np.linalg.norm(centres[0]))
    near = x @ centres[0]
    for _ in range(min(CLUSTERS, len(x)) - 1):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(ROUNDS):
        which = (x @ c.T).argmax(axis=1)
        for k in range(len(c)):
            if (which == k).any():
                total = x[which == k].sum(axis=0)
                c[k] = total / max(1e-9, np.linalg.norm(total))
    return c


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> dict:
    """The model: idf, centroids, the language of each, and each language's largest usual distance."""
    import numpy as np
    import pandas as pd

    bounded_batches(docs.sparkSession)
    labelled = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    n, df = document_frequencies(labelled, text)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_h", text])
        x, has = vectors(rows[text].tolist(), idf)
        x = x[has]
        if not len(x):
            return pd.DataFrame({"label": [], "centre": [], "reach": []})
        c = cluster(x)
        reach = float(np.quantile(1 - (x @ c.T).max(axis=1), 0.999))
        return pd.DataFrame({"label": rows[label].iloc[0], "centre": [v.astype("<f4").tobytes() for v in c], "reach": reach})

    found = (sample(labelled, key, text, label, SAMPLE).groupBy(label)
             .applyInPandas(fit, "label string, centre binary, reach double").orderBy("label", "centre").collect())
    centres = np.array([np.frombuffer(r["centre"], "<f4") for r in found]).reshape(len(found), 1 << BITS)
    return {"idf": idf, "centres": centres, "labels": [r["label"] for r in found], "reach": np.array([r["reach"] for r in found])}


def predict(docs: DataFrame, model: dict, text: str = "text", out: tuple[str, str, str, str] = ("lang_pred", "score", "distance", "rejected")) -> DataFrame:
    """All columns and: the language, a score from 0 to 1, the distance to the nearest centroid, and whether it is too far."""
    import numpy as np
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    names = [free_name(docs, n) for n in out]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x clusters x 2^BITS numbers

    def run(batches):
        m = shared.value
        langs = sorted(set(m["labels"]))
        of = np.array([langs.index(x) for x in m["labels"]], np.int64)
        turned = np.ascontiguousarray(m["centres"].T)
        for b in blocks(batches, text, rows=256):
            x, has = vectors(b.column(b.schema.get_field_index(text)).to_pylist(), m["idf"])
            lang, score, far, away = [], [], [], []
            if langs:
                cosine = x @ turned
                best = np.stack([cosine[:, of == k].max(axis=1) for k in range(len(langs))], axis=1).astype(np.float64)
                power = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
                share = power.max(axis=1) / power.sum(axis=1)
                top, distance = best.argmax(axis=1), 1 - best.max(axis=1)
                reach = np.array([m["reach"][of == k].max() for k in range(len(langs))])
            for i, known in enumerate(has):
                good = bool(known) and bool(langs)
                lang.append(langs[top[i]] if good else UNKNOWN)
                score.append(float(share[i]) if good else 0.0)
                far.append(float(distance[i]) if good else None)
                away.append(bool(distance[i] > reach[top[i]]) if good else True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(far, pa.float64()), pa.array(away, pa.bool_())], names=[*b.schema.names, *names])

    kinds = ["string", "double", "double", "boolean"]
    return docs.mapInArrow(run, ddl(docs) + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
