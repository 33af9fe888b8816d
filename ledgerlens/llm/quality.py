"""Quality classifier from weak labels.

1. Overlapping heuristic labellers each vote good (1), bad (0) or abstain (-1) on every whole text.
2. Expectation-maximisation (two classes, labellers independent given the class) estimates the class prior and each
   labeller's accuracy. It runs on the counts of vote patterns of the whole corpus, which Spark adds up; there are at
   most 3^10 = 59,049 patterns, so this table is bounded whatever the corpus.
3. The posterior of each pattern is the soft label of its documents. On a bounded sample of ``train_rows`` documents
   (a parameter) they train a linear scorer over hashed features: shapes of words, pairs of shapes, and repeats.
4. The scorer gives every document a score; below 0.5 the document is rejected.

Word shapes (letters folded to ``a``/``A``, digits to ``0``, runs shortened to one or two) carry over to unseen vocabulary and
other languages.

Defined results: a null or empty text has no features and all labellers abstain, so its score is that of the scorer's
bias, the prior. An empty table gives no rows. Repeated rows each give a row. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, materialise, slices, text_of

#: Each looks at one trait. A defect finder votes bad or abstains: that a defect is absent says nothing about the others.
LABELLERS = ("symbols", "marks", "capitals", "shouting", "stutter", "variety", "pipes", "bare", "sentences", "plain")
ABSTAIN, BAD, GOOD = -1, 0, 1
#: Hashed feature space and the default bound of the training sample.
FEATURES = 2048
TRAIN_ROWS = 4096

_SYMBOLS = b"#*$%&^~@\\{}<>="
#: Byte classes for shapes: letters a and A (bytes of other scripts count as a), digits 0, ASCII white space one blank.
_SHAPE = bytes(97 if c >= 0x80 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))
_PLAIN = frozenset([b"a", b"aa", b"a,", b"aa,", b"a.", b"aa."])


class View:
    """What the labellers and the features need to know of one text."""

    def __init__(self, text: str):
        from collections import Counter

        import numpy as np

        self.raw = text.encode()
        self.words = self.raw.split()
        self.n = len(self.words)
        whole = self.raw.translate(_SHAPE)
        self.lower, self.upper = whole.count(b"a"), whole.count(b"A")
        self.blanks, self.digits = whole.count(b" "), whole.count(b"0")
        self.same = sum(map(bytes.__eq__, self.words, self.words[1:]))
        codes = np.frombuffer(whole, np.uint8)
        keep = np.ones(len(codes), bool)
        keep[2:] = (codes[2:] != codes[1:-1]) | (codes[1:-1] != codes[:-2])  # at most two of a kind in a row
        self.shapes = codes[keep].tobytes().split()
        self.counts = Counter(self.shapes)


def votes(view: View) -> str:
    """One character by labeller, in the order of ``LABELLERS``: g good, b bad, - abstains."""
    n, raw = view.n, view.raw
    if not n:
        return "-" * len(LABELLERS)
    letters = max(1, view.lower + view.upper)
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    marks = (len(raw) - letters - view.blanks - view.digits) / letters
    ends = sum(k for s, k in view.counts.items() if s[-1:] in (b".", b"?", b"!", b":"))
    bare = sum(k for s, k in view.counts.items() if b"a" not in s and b"A" not in s and b"0" not in s)
    plain = sum(k for s, k in view.counts.items() if s in _PLAIN) / n
    per = n / max(1, ends)
    bad, good, none = "b", "g", "-"
    return "".join([
        bad if symbols / n > 0.2 else none,
        bad if marks > 0.2 else good if marks < 0.06 else none,
        bad if view.upper / letters > 0.5 and letters >= 20 else none,
        bad if raw.count(b"!") / n > 0.3 else none,
        bad if view.same / n > 0.3 and n >= 8 else none,
        bad if n >= 20 and len(set(zip(view.words, view.words[1:]))) / n < 0.3 else none,
        bad if raw.count(b"|") / n > 0.12 else none,
        bad if bare / n > 0.12 and n >= 6 else none,
        bad if per > 60 else good if 2 <= per <= 40 else none,
        bad if plain < 0.4 and n >= 6 else good if plain > 0.7 else none,
    ])


def features(view: View) -> dict[int, float]:
    """Hashed features of one text: relative frequencies by slot."""
    from collections import Counter

    n = view.n
    found: dict[int, float] = {}
    if not n:
        return found

    def add(key: bytes, share: float) -> None:
        slot = crc32(key) % FEATURES
        found[slot] = found.get(slot, 0.0) + share

    for s, k in view.counts.items():
        add(b"1 " + s, k / n)
    for (s, t), k in Counter(zip(view.shapes, view.shapes[1:])).items():
        add(b"2 " + s + b" " + t, k / n)
    add(b"repeat", view.same / n)
    return found


def fit_em(counts: dict[str, int], rounds: int = 300):
    """EM over counts by vote pattern. Gives the prior of good, P(vote | class) as [labeller][class][vote] in the order -bg, and the posterior of good by pattern."""
    import numpy as np

    patterns = sorted(counts)
    if not patterns:
        return 0.5, None, {}
    v = np.array([["-bg".index(c) for c in p] for p in patterns])
    w = np.array([counts[p] for p in patterns], float)
    seen, m = v > 0, v.shape[1]
    post = ((v == 2).sum(1) + 1.0) / (seen.sum(1) + 2.0)  # start: the majority
    for _ in range(rounds):
        share = np.stack([w * (1 - post), w * post])
        prior = np.clip(share[1].sum() / w.sum(), 1e-4, 1 - 1e-4)
        table = np.stack([np.stack([np.bincount(v[:, j], weights=s, minlength=3) + 0.5 for s in share]) for j in range(m)])
        table /= table.sum(axis=2, keepdims=True)
        logit = np.log(prior / (1 - prior)) + sum(np.log(table[j, 1, v[:, j]] / table[j, 0, v[:, j]]) * seen[:, j] for j in range(m))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done, post = np.abs(new - post).max() < 1e-9, new
        if done:
            break
    return float(prior), table, {p: float(x) for p, x in zip(patterns, post)}


def fit_scorer(rows: list[tuple[dict[int, float], float]], rounds: int = 300, decay: float = 1e-4):
    """Logistic regression on soft labels by gradient descent with momentum; classes that occur weigh the same. Gives (weights, bias)."""
    import numpy as np

    x = np.zeros((len(rows), FEATURES), np.float32)
    y = np.array([p for _, p in rows], np.float32)
    if not len(rows):
        return np.zeros(FEATURES, np.float32), 0.0
    for i, (f, _) in enumerate(rows):
        x[i, list(f)] = list(f.values())
    good = float(y.sum())
    bad = len(y) - good
    both = (y < 0.5).any() and (y >= 0.5).any()  # with one class only, the doubt of its members must not be weighed up
    weight = y / max(good, 1e-3) + (1 - y) / max(bad, 1e-3) if both else np.full(len(y), 1 / len(y), np.float32)
    weight /= weight.sum()
    w, b = np.zeros(FEATURES, np.float32), float(np.log((good + 1) / (bad + 1)))
    vw, rate = np.zeros_like(w), 8.0
    for _ in range(rounds):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y)
        vw = 0.9 * vw - rate * (x.T @ g + decay * w)
        w += vw
    return w, b


class QualityModel:
    def __init__(self, prior, accuracies, posterior, weights, bias):
        self.prior, self.accuracies, self.posterior, self.weights, self.bias = prior, accuracies, posterior, weights, bias

    def score(self, view: View) -> float:
        import math

        z = self.bias + sum(float(self.weights[i]) * x for i, x in features(view).items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def label(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the vote pattern (one character by labeller: g, b or -) of every row."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, "text"):
            marks = [votes(View(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(marks)], names=["doc_id", "text_key", "votes"])

    rows = _text_rows(docs).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, votes string")


def fit(docs: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """EM over the votes of all rows of ``labelled``, then the scorer on a sample of at most ``train_rows`` rows."""
    counts = labelled.groupBy("votes").count().collect()  # at most 3 ** len(LABELLERS) rows
    counted = {r["votes"]: r["count"] for r in counts}
    total = sum(counted.values())
    prior, table, soft = fit_em(counted)
    if total:
        # a uniform share by hash of id and text; the limit only cuts what chance adds to the bound
        draw = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 40))
        bound = min(1 << 40, int((1 << 40) * 0.9 * train_rows / total) + 1)
        sample = _text_rows(docs).filter(draw < bound).limit(train_rows)

        def run(batches):
            import pyarrow as pa

            for b in slices(batches, "text"):
                for t in b.column(1).to_pylist():
                    view = View(t)
                    f, mark = features(view), votes(view)
                    yield pa.RecordBatch.from_arrays([pa.array([mark]), pa.array([list(f)], pa.list_(pa.int32())), pa.array([list(f.values())], pa.list_(pa.float32()))], names=["votes", "slots", "shares"])

        drawn = sample.mapInArrow(run, "votes string, slots array<int>, shares array<float>").collect()
        rows = sorted(((sorted(zip(r["slots"], r["shares"])), soft[r["votes"]]) for r in drawn), key=repr)
        weights, bias = fit_scorer([(dict(f), y) for f, y in rows])
    else:
        weights, bias = fit_scorer([])
    return QualityModel(prior, table, soft, weights, bias)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Every row of ``docs`` with all its columns and a score in a column ``score`` (underscores in front if taken)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # FEATURES floats and at most 3 ** 10 posteriors
    (out, text) = fresh(docs, "score", "text_")
    rows = docs.withColumn(text, text_of())
    schema = docs.withColumn(out, F.lit(0.0)).schema

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in slices(batches, text):
            at = b.schema.get_field_index(text)
            marks = pa.array([m.score(View(t)) for t in b.column(at).to_pylist()], pa.float64())
            names = [n for n in b.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at] + [marks], names=[*names, out])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, votes, posterior (from the labellers), score (from the scorer), kept: one row per document."""
    spark = docs.sparkSession
    model = fit(docs, materialise(label(docs), "votes"), train_rows)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in slices(batches, "text"):
            marks, scores = [], []
            for t in b.column(1).to_pylist():
                view = View(t)
                marks.append(votes(view))
                scores.append(round(m.score(view), 6))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks), pa.array([round(m.posterior[x], 6) for x in marks], pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= 0.5 for s in scores])],
                                             names=["doc_id", "votes", "posterior", "score", "kept"])

    return _text_rows(docs).mapInArrow(run, "doc_id long, votes string, posterior double, score double, kept boolean")


def drop_rejected(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    model = fit(docs, materialise(label(docs), "votes"), train_rows)
    (mark,) = fresh(docs, "score")
    return score(docs, model).filter(F.col(mark) >= 0.5).drop(mark)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
