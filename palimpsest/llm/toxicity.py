"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - t_k): one weight vector for all thresholds t_0 < t_1 < ..., so a feature moves every
threshold alike. Features are the distinct words of a text and their 4 to 6 letter beginnings, hashed; a text's vector
has 1 for each feature that it has, whatever its length. The model is fitted here, on a bounded sample of labelled
documents; counts of features come from that sample alone, and every document of the corpus is scored.

Where labels only say toxic or not, degrees come from held-out counts: the sample falls into two halves, each finds the
features that tell toxic texts, and a toxic text of the other half with more of them than the median has grade 2.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import durable, packed, unpacked
from palimpsest.llm.remembered import begins, giving_back

#: At most so many labelled documents are fitted on: those with the smallest hashes of doc_id, half of them toxic if there are.
SAMPLE = 8_000
#: At most so many grades are told apart.
GRADES = 100
#: A feature whose count differs between clean and toxic documents by less (chi squared, one degree of freedom) is chance.
CHI = 20.0
#: A feature must be in at least 5 documents of the sample, and in as many as this share of its toxic ones.
SUPPORT = 0.01
#: A feature must be so many times as likely, or as unlikely, in toxic documents: what all prose of a kind has is no sign.
RATIO = 4.0
#: A feature is one of so many buckets.
BUCKETS = (1 << 31) - 1
#: A document is rejected from this expected severity on.
REJECT = 0.5
WORD = re.compile(r"[^\W\d_]+")
#: A worker remembers so many words at most, each shorter than LONGEST.
KEPT, LONGEST = 200_000, 40


@dataclass(frozen=True)
class Model:
    """bucket: sorted feature buckets; weight: theirs; cuts: ascending thresholds."""

    bucket: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray

    def latent(self, text: str | None) -> float:
        own = self.__dict__.get("_own")
        if own is None:
            own = dict(zip(self.bucket.tolist(), self.weight.tolist(), strict=True)), _told_by(self.bucket.tobytes())
            object.__setattr__(self, "_own", own)
        known, told = own
        found: set[int] = set()
        for w in words(text):
            of = told.get(w)
            if of is None:
                of = tuple(b for b in _hashed(w) if b in known)
                if len(told) < KEPT and len(w) < LONGEST:
                    told[w] = of
            if of:
                found.update(of)
        return sum(map(known.__getitem__, found))

    def __reduce__(self):
        return Model, (self.bucket, self.weight, self.cuts)  # not what it remembers

    def above(self, latent: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, a column each."""
        return 1 / (1 + np.exp(-np.clip(latent[:, None] - self.cuts[None, :], -40, 40)))


#: Words that a worker remembers while it works out features, with their buckets, and while it scores, with those of
#: their buckets that the model has: most words have none.
_by_word: dict[str, tuple[int, ...]] = {}
_told: dict[bytes, dict[str, tuple[int, ...]]] = {}


def _told_by(model: bytes) -> dict[str, tuple[int, ...]]:
    """What is remembered of words for a model with these buckets; that for another one is dropped."""
    if model not in _told:
        _told.clear()
        _told[model] = {}
    return _told[model]


def _forget() -> None:
    _by_word.clear()
    _told.clear()


def _hashed(word: str) -> tuple[int, ...]:
    """The buckets of a word: itself and its beginnings. FNV-1a over code points, taken letter by letter."""
    h, out = 0xCBF29CE484222325, []
    for i, c in enumerate(word, 1):
        h = (h ^ ord(c)) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        if 4 <= i <= 6:
            out.append((h ^ h >> 29) % BUCKETS)
    out.append((h * 31 + 7 ^ h >> 31) % BUCKETS)
    return tuple(out)


def _of_word(word: str) -> tuple[int, ...]:
    """_hashed(), remembered."""
    found = _by_word.get(word)
    if found is None:
        found = _hashed(word)
        if len(_by_word) < KEPT and len(word) < LONGEST:
            _by_word[word] = found
    return found


def words(text: str | None) -> set[str]:
    """The distinct words of a whole text in lower case; none for null."""
    return set(WORD.findall((text or "").lower()))


def buckets(text: str | None) -> set[int]:
    """The hashed features of a whole text; none for null."""
    return {b for w in words(text) for b in _of_word(w)}


def _features(batches):
    begins("toxicity", _forget)
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "grade": b["grade"], "features": [sorted(buckets(t)) for t in b["text"]]})


def _telling(counts: DataFrame, every: int, positive: int, all_: str, pos: str, least: float) -> DataFrame:
    """f, up (it is a sign of toxic texts) of the features that tell grade 0 from the others by chi squared of at least CHI, RATIO times as likely in one of them."""
    with_, without = F.col(pos).cast("double"), F.col(all_) - F.col(pos).cast("double")
    cross = with_ * (every - positive - without) - without * (positive - with_)
    chi = F.try_divide(every * cross * cross, F.lit(float(positive)) * (every - positive) * F.col(all_) * (every - F.col(all_)))
    times = ((with_ + 0.5) / (positive + 1)) / ((without + 0.5) / (every - positive + 1))
    found = counts.where((F.col(all_) >= max(5, least)) & (F.col(all_) < every)).select("f", F.round(chi, 6).alias("chi"), times.alias("times"))
    return found.where((F.col("chi") >= CHI) & ((F.col("times") >= RATIO) | (F.col("times") <= 1 / RATIO))).select("f", (F.col("times") > 1).alias("up"))


def sample(docs: DataFrame, grades: DataFrame, size: int = SAMPLE) -> pd.DataFrame:
    """doc_id, grade, features, signs of at most `size` graded documents: of each grade the smallest hashes, grades in equal shares where there are enough.

    Of a document's features those are kept that tell grade 0 from the others; each is in SUPPORT of the sample's toxic
    texts, so they are no more than the sample's words over that. signs: how many features the document has that are
    signs of toxic texts in the other half of the sample. Counting and choosing are aggregates over the sample.
    A document with several grades has the highest. More than GRADES grades are an error.
    """
    spark = docs.sparkSession
    known = grades.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).select(F.col("doc_id").cast("long"), F.col("grade").cast("int"))
    known = known.groupBy("doc_id").agg(F.max("grade").alias("grade")).withColumn("h", F.xxhash64("doc_id"))
    per = [r["grade"] for r in known.select("grade").distinct().limit(GRADES + 1).collect()]
    if len(per) > GRADES:
        raise ValueError(f"more than {GRADES} grades")
    picked = [known.where(F.col("grade") == g).orderBy("h", "doc_id").limit(size // max(1, len(per))) for g in sorted(per)]
    ids = spark.createDataFrame([r for p in picked for r in p.select("doc_id", "grade").collect()], "doc_id long, grade int")
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id")
    rows = durable(plain.mapInPandas(giving_back(_features), "doc_id long, grade int, features array<int>"), "toxicity-sample")
    # Copies of one text aren't independent evidence: of texts with the same four smallest hashes in common one stays.
    alike = F.when(F.size("features") > 0, F.slice("features", 1, 4)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")))
    first = rows.groupBy("grade", alike.alias("alike")).agg(F.min(F.struct("doc_id", "features")).alias("r"))
    rows = durable(first.select("r.doc_id", "grade", "r.features", F.pmod(F.xxhash64("alike"), F.lit(2)).alias("half")), "toxicity-distinct")
    toxic, own = F.col("grade") > 0, [F.col("half") == h for h in (0, 1)]
    total = rows.agg(*(F.count_if(own[h]).alias(f"n{h}") for h in (0, 1)), *(F.count_if(own[h] & toxic).alias(f"p{h}") for h in (0, 1))).first()
    each = rows.select("grade", "half", F.explode("features").alias("f")).groupBy("f")
    counts = each.agg(*(F.count_if(own[h]).alias(f"all{h}") for h in (0, 1)), *(F.count_if(own[h] & toxic).alias(f"pos{h}") for h in (0, 1)))
    counts = durable(counts.where(F.col("all0") + F.col("all1") >= 5).withColumn("all", F.col("all0") + F.col("all1")).withColumn("pos", F.col("pos0") + F.col("pos1")), "toxicity-counts")
    positive = total["p0"] + total["p1"]
    best = [r["f"] for r in _telling(counts, total["n0"] + total["n1"], positive, "all", "pos", SUPPORT * positive).collect()]
    signs = [[r["f"] for r in _telling(counts, total[f"n{h}"], total[f"p{h}"], f"all{h}", f"pos{h}", SUPPORT * total[f"p{h}"]).where("up").collect()] for h in (0, 1)]

    def among(found: list[int]):
        return F.array_intersect("features", F.lit(sorted(found)).cast("array<int>"))

    held_out = F.when(own[0], F.size(among(signs[1]))).otherwise(F.size(among(signs[0])))
    return rows.select("doc_id", "grade", among(best).alias("features"), held_out.alias("signs")).toPandas().sort_values("doc_id", ignore_index=True)


def by_signs(rows: pd.DataFrame) -> pd.DataFrame:
    """sample() rows of grades 0 and 1 with grade 2 for those of grade 1 that have more signs than their median."""
    toxic = rows["grade"] > 0
    middle = rows.loc[toxic, "signs"].median() if toxic.any() else 0
    return rows.assign(grade=rows["grade"].where(~toxic | (rows["signs"] <= middle), 2))


def fit(rows: pd.DataFrame, rounds: int = 800, rate: float = 0.1, penalty: float = 1e-5) -> Model:
    """Maximum likelihood of the cumulative-link model by Adam over all sample rows, with a ridge penalty.

    Grades are 0, 1, 2, ...; without rows or with one grade alone the model gives everything severity 0. Rows
    weigh alike: a text without a telling feature is as likely toxic as such texts of the sample are.
    """
    if len(rows) == 0 or rows["grade"].nunique() < 2:
        return Model(np.empty(0, dtype=np.int64), np.empty(0), np.array([40.0]))
    grade = rows["grade"].to_numpy()
    flat = np.concatenate([*(np.asarray(f, dtype=np.int64) for f in rows["features"]), np.empty(0, dtype=np.int64)])
    names, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(rows)), rows["features"].map(len).to_numpy())
    k, n = int(grade.max()), len(rows)
    w, first, gaps = np.zeros(len(names)), 0.0, np.zeros(k - 1)
    target = (grade[:, None] > np.arange(k)[None, :]).astype(float)
    cost = 1.0 / n
    m = v = np.zeros(len(names) + k)
    for step in range(1, rounds + 1):
        cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        latent = np.bincount(row, weights=w[column], minlength=n)
        # For each threshold a logistic loss with the weights in common.
        error = cost * (1 / (1 + np.exp(-np.clip(latent[:, None] - cuts[None, :], -40, 40))) - target)
        to_cut = -error.sum(axis=0)
        grad_w = np.bincount(column, weights=error.sum(axis=1)[row], minlength=len(names)) + penalty * w
        grad_gaps = np.array([to_cut[i + 1 :].sum() * np.exp(gaps[i]) for i in range(k - 1)])
        grad = np.concatenate([grad_w, [to_cut.sum()], grad_gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, first, gaps = w - move[: len(names)], first - move[len(names)], gaps - move[len(names) + 1 :]
    return Model(names, w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade from the 0/1 label `toxic`. Any table of doc_id and grade can stand in for this one."""
    return labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("grade"))


def score(rows: DataFrame, model: Model, keep: list[str], clean_only: bool = False, reject: float = REJECT) -> DataFrame:
    """The columns `keep` of rows, which has `text`, with severity (expected grade), grade (likeliest) and toxic (severity >= reject).

    clean_only: without the toxic rows, which then never leave the worker.
    """

    def run(batches):
        begins("toxicity", _forget)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                latent = [model.latent(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
                above = model.above(np.array(latent, dtype=float))
                each = -np.diff(np.hstack([np.ones((len(latent), 1)), above, np.zeros((len(latent), 1))]), axis=1)
                severity = above.sum(axis=1)
                new = [pa.array(severity), pa.array(each.argmax(axis=1), pa.int32()), pa.array(severity >= reject)]
                out = pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *new], names=[*keep, "severity", "grade", "toxic"])
                yield out.filter(pa.array(severity < reject)) if clean_only else out

    fields = [*(rows.schema[c] for c in keep), *T.StructType.fromDDL("severity double, grade int, toxic boolean").fields]
    return rows.mapInArrow(giving_back(run), T.StructType(fields))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """A model fitted on the labelled documents, with the degrees of by_signs()."""
    return fit(by_signs(sample(docs, graded(labels))))


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, grade, toxic of every document. A null or empty text has no feature and its severity is what the thresholds alone give."""
    model = trained(docs, labels)
    return score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model, ["doc_id"])


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of docs, without the documents that the model rejects."""
    model = trained(docs, labels)
    return score(packed(docs, "text"), model, ["_row"], clean_only=True).select(*unpacked(docs.columns))
