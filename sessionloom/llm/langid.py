"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed character n-grams (1 to 3) of the lower-cased text with
every non-letter as a blank, square-rooted counts scaled to length one. Family
classifiers are one-versus-one as well; `FAMILIES` names known families and any
other label is a family of its own. Training uses a bounded sample,
`max_per_lang` documents of each language (those with the smallest hash of
their id), which is the one bound in this module; predictions read whole texts. Whole texts stay on the executors: the driver gets the sample's features. The model has
32 KB for each two languages of a family and each two families; it is sent to the workers, at most 650 MB where max_langs labels are all unknown, each a family of its own.

Texts that are null or have no letter get UNDETERMINED and score 0. Without any
labelled text everything is UNDETERMINED; with one language, everything with a
letter is that language at score 1. Rows that repeat are predicted each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import alone, parts, unused, workers_find_package

UNDETERMINED = "und"
BITS = 13
#: Language codes by family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "sk", "cs", "pl"],
    "uralic": ["fi", "et", "hu"],
    "baltic": ["lt", "lv"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "indic": ["hi", "bn", "mr", "ne", "gu", "pa", "ur", "si"],
    "semitic": ["ar", "he", "mt", "am"],
    "sinitic": ["zh", "yue"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


@cache
def _letters() -> np.ndarray:
    """Code point of the basic plane -> its code, or 32 where it isn't a letter."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint32)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of 2**BITS hashed n-grams, or None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if code.max() < 0x10000:
        code = _letters()[code]
    else:
        far = np.unique(code[code >= 0x10000])
        keep = np.isin(code, far[[chr(c).isalpha() for c in far]])
        code = np.where(keep, code, _letters()[np.minimum(code, 0xFFFF)] * (code < 0x10000) + 32 * (code >= 0x10000)).astype(np.uint32)
    if not (code != 32).any():
        return None
    code = np.concatenate([np.array([32], np.uint32), code, np.array([32], np.uint32)])
    one = code * np.uint32(2654435761)
    two = one[:-1] * np.uint32(31) + one[1:] * np.uint32(17) + np.uint32(1)
    three = two[:-1] * np.uint32(37) + one[2:] * np.uint32(13) + np.uint32(2)
    shift = np.uint32(32 - BITS)
    x = np.bincount(np.concatenate([(g ^ (g >> np.uint32(15))) * np.uint32(0x9E3779B1) >> shift for g in (one, two, three)]), minlength=1 << BITS)
    x = np.sqrt(x.astype(np.float32))
    return x / np.sqrt((x * x).sum())


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent; y is +1 or -1. The bias is a constant feature."""
    n = len(x)
    w, b, a = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(n)
    rng = np.random.default_rng(seed)
    norm = (x * x).sum(axis=1) + 1.0
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            g = y[i] * (float(w @ x[i]) + b) - 1.0
            new = min(max(a[i] - g / norm[i], 0.0), cost)
            d = (new - a[i]) * y[i]
            if d:
                w += np.float32(d) * x[i]
                b += d
                a[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, b


@dataclass
class Model:
    """One-versus-one hyperplanes: the first `families` between families, the others within one."""

    langs: list[str]
    families: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def _vote(self, names: list[str], margin: dict) -> tuple[str, float]:
        """Most one-versus-one wins, ties by summed margins then name; the score is the winner's mean probability."""
        if len(names) == 1:
            return names[0], 1.0
        wins, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        chance: dict[str, list[float]] = {x: [] for x in names}
        for a, b in combinations(names, 2):
            m = margin[a, b]
            wins[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
            p = 1 / (1 + np.exp(-4.0 * np.clip(m, -20, 20)))
            chance[a].append(p)
            chance[b].append(1 - p)
        best = min(names, key=lambda x: (-wins[x], -total[x], x))
        return best, float(np.mean(chance[best]))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or not self.langs:
            return UNDETERMINED, 0.0
        margin = {} if self.weights is None else dict(zip(self.pairs, (self.weights @ x + self.bias).tolist(), strict=True))
        family, p = self._vote(self.families, margin)
        lang, q = self._vote([x for x in self.langs if f"={FAMILY_OF.get(x, x)}" == family], margin)
        return lang, p * q


def fit(texts: list[str], langs: list[str]) -> Model:
    return fit_vectors([features(t) for t in texts], langs)


def fit_vectors(vectors: list[np.ndarray | None], langs: list[str]) -> Model:
    """The model of features(); None is left out."""
    rows = [(v, lang) for v, lang in zip(vectors, langs, strict=True) if v is not None]
    model = Model(sorted({lang for _, lang in rows}))
    if not model.langs:
        return model
    x = np.stack([v for v, _ in rows])
    lang = np.array([s for _, s in rows])
    family = np.array([f"={FAMILY_OF.get(s, s)}" for s in lang])
    model.families = sorted(set(family))
    planes = []
    for label, groups in ((family, [model.families]), (lang, [[s for s in model.langs if f"={FAMILY_OF.get(s, s)}" == f] for f in model.families])):
        for names in groups:
            for a, b in combinations(names, 2):
                use = (label == a) | (label == b)
                model.pairs.append((a, b))
                planes.append(linear_svm(x[use], np.where(label[use] == a, 1.0, -1.0)))
    if planes:
        model.weights = np.stack([w for w, _ in planes])
        model.bias = np.array([b for _, b in planes])
    return model


def bucket(id_col: str):
    """crc32 of the id as text, mod 3: 1 is held out. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_lang: int = 500, max_langs: int = 200, max_texts: int = 20_000) -> Model:
    """Fit on at most max_per_lang documents of each of the max_langs most frequent languages, max_texts in all, none of them held out.

    The sample are the rows with the smallest hash of id and text, read by a threshold, so no text is shuffled and a repeated id has no more of it than
    any other.
    """
    q = lambda c: F.col(f"`{c}`")
    lang, text = q(lang_col).cast("string"), q(text_col).cast("string")
    usable = (bucket(id_col) != 1) & lang.isNotNull()
    rank = F.pmod(F.xxhash64(q(id_col), text), F.lit(1_000_000_007))
    counts = documents.where(usable).groupBy(lang.alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not counts:
        return Model([])
    each = max(1, min(max_per_lang, max_texts // len(counts)))
    cut = F.lit(0)
    for r in counts:
        cut = F.when(lang == r.lang, F.lit(int(min(1.0, 1.3 * each / r["count"]) * 1_000_000_007))).otherwise(cut)
    # Rows that are the same count once, so the sample stays near its bound whatever repeats.
    rows = documents.where(usable & text.isNotNull() & (rank < cut)).select(rank.alias("r"), lang.alias("lang"), text.alias("text")).dropDuplicates(["lang", "r"])
    # Features are made where the texts are; what comes to the driver is their parts that aren't 0, at most 6 * 2 ** BITS bytes for each of about max_texts rows.
    workers_find_package(documents.sparkSession)
    pdf = rows.mapInArrow(_sparse, "r long, lang string, at binary, value binary").toPandas().sort_values(["lang", "r"]).groupby("lang").head(each)
    return fit_vectors([_dense(a, v) for a, v in zip(pdf["at"], pdf["value"], strict=True)], pdf["lang"].tolist())


def _sparse(batches):
    """(r, lang, at, value) of (r, lang, text): where the features aren't 0, and what they are there; null without a letter."""
    alone()
    for batch in batches:
        for part in parts(batch, 2):
            found = [features(t) for t in part.column(2).to_pylist()]
            at = [None if v is None else np.flatnonzero(v).astype("<u2") for v in found]
            value = [None if v is None else v[a].astype("<f4").tobytes() for v, a in zip(found, at, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([None if a is None else a.tobytes() for a in at], pa.binary()), pa.array(value, pa.binary())], names=["r", "lang", "at", "value"])


def _dense(at: bytes | None, value: bytes | None) -> np.ndarray | None:
    if at is None or value is None:
        return None
    x = np.zeros(1 << BITS, np.float32)
    x[np.frombuffer(at, "<u2")] = np.frombuffer(value, "<f4")
    return x


def _verdict(spark, model: Model):
    """Text column -> struct(lang_pred, score); marked so that a filter on it isn't pushed below and run again."""
    workers_find_package(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def verdict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        alone()
        for text in texts:
            found = [sent.value.predict(t) for part in parts(pa.RecordBatch.from_arrays([text], ["text"]), 0) for t in part.column(0).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([lang for lang, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())], ["lang_pred", "score"])

    return verdict.asNondeterministic()


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score), a row for each row of documents."""
    verdict = _verdict(documents.sparkSession, model)
    seen = documents.select(F.col(id_col), verdict(F.col(text_col).cast("string")).alias("__verdict"))
    return seen.select(id_col, "__verdict.lang_pred", "__verdict.score")


def relabel(documents: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", min_score: float = 0.0) -> DataFrame:
    """documents with lang_col as predicted from the text, without those that are undetermined or score under min_score. All columns stay."""
    verdict = _verdict(documents.sparkSession, model)
    columns = documents.columns
    (name,) = unused(columns, "verdict")
    seen = documents.withColumn(name, verdict(F.col(f"`{text_col}`").cast("string")))
    kept = seen.where((F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.score") >= min_score))
    return kept.withColumn(lang_col, F.col(f"{name}.lang_pred")).select(*[F.col(f"`{c}`") for c in columns])


def held_out(id_: object) -> bool:
    return zlib.crc32(("" if id_ is None else str(id_)).encode()) % 3 == 1
