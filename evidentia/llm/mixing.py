"""Mixing to target weights with soft membership.

A classifier fitted on a bounded sample of the labelled table gives every document posteriors over domains. Each document i with n_i
tokens gets a rate r_i in [0, max_rate]; the expected tokens of domain k are sum_i r_i n_i p_ik. Accelerated projected gradient moves the
rates until these totals match the targets in weighted least squares, with a light pull to rate 1. The weights are the inverse of
the domains' second moments, so the unconstrained problem takes one step and bounds take a few. One pass over (n, p) a step sends
the driver one vector of domain totals; the rates themselves never travel, they are recomputed from the short history of slopes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import map_chunks, map_slices, save

DOMAINS = ("clean", "low", "toxic")
#: Labelled documents, on average, that the classifier is fitted on; words that it may use, and in how many of them a word must be.
FIT_DOCS, FIT_WORDS, LEAST_DOCS = 4000, 4096, 4
WEIGHTS = {"clean": 0.9, "low": 0.05, "toxic": 0.05}
STEPS, PULL, MAX_RATE = 32, 1e-3, 4.0
SHAPES = ("symbols", "bangs", "bars", "upper", "few_kinds", "short", "repeated_lines")
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_CAPITALS = bytes(range(65, 91))


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The domain of a row of ``labels``: toxic first, then quality; null without either label."""
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 0, "low").when(F.col(quality) == 1, "clean")


def look(text: str | None) -> tuple[int, set[bytes], list[int]]:
    """Token count, distinct words without case and ASCII punctuation, and the shape features of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw.split())
    words = set(raw.lower().translate(None, _PUNCTUATION).split())
    lines = [x for x in raw.split(b"\n") if x]
    marks = [
        sum(map(raw.count, (b"*", b"#", b"$", b"%", b"&"))) > 0.3 * n,
        raw.count(b"!!") > 0.3 * n,
        raw.count(b"|") > 0.2 * n,
        3 * (len(raw) - len(raw.translate(None, _CAPITALS))) > len(raw),
        n >= 20 and len(words) < 0.3 * min(n, 200),
        n < 10,
        len(lines) >= 4 and 2 * len(set(lines)) < len(lines),
    ]
    return n, words, [k for k, m in enumerate(marks) if n and m]


@dataclass
class Classifier:
    """Softmax regression over shape features and chosen words."""

    domains: tuple[str, ...]
    words: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray | None = None  # feature by domain, the last row is the bias

    def posteriors(self, seen: list[tuple[int, set[bytes], list[int]]]) -> np.ndarray:
        """A row of posteriors a document; uniform without labelled documents to learn from."""
        if self.weights is None:
            return np.full((len(seen), len(self.domains)), 1 / len(self.domains))
        logits = np.tile(self.weights[-1], (len(seen), 1))
        names = self.words.keys()
        for i, (_, words, shapes) in enumerate(seen):
            logits[i] += self.weights[shapes + [self.words[w] for w in names & words]].sum(0)
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, fit_docs: int = FIT_DOCS) -> Classifier:
    """Fits on about ``fit_docs`` rows of ``labelled`` (doc_id, domain), drawn by a hash of the id, joined to their whole texts.

    The sample is the only thing broadcast to the join; its size has that bound at any input size. Words are counted and chosen on Spark,
    so that the driver gets FIT_WORDS words and, for each document of the sample, which of them it has.
    """
    known = labelled.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).select("doc_id", "domain")
    share = fit_docs / max(1, known.count())
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)))

    def features(batches):
        for batch in batches:
            rows = batch.to_pydict()
            seen = [look(t) for t in rows["text"]]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(rows["doc_id"], pa.int64()), "domain": pa.array(rows["domain"], pa.string()), "words": pa.array([sorted(w) for _, w, _ in seen], pa.list_(pa.binary())), "shapes": pa.array([s for _, _, s in seen], pa.list_(pa.int32()))})

    met = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id").select("doc_id", "domain", "text")
    seen = save(met.mapInArrow(features, "doc_id long, domain string, words array<binary>, shapes array<int>"), "mix-sample")
    sizes = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Classifier(domains)
    rates = [(F.count_if(F.col("domain") == d) + 0.5) / F.lit(sizes.get(d, 0) + 1.0) for d in domains]
    often = seen.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *[r.alias(f"r{k}") for k, r in enumerate(rates)]).where(F.col("n") >= LEAST_DOCS)
    most, least = (f(*[F.col(f"r{k}") for k in range(len(domains))]) for f in (F.greatest, F.least))
    chosen = often.orderBy(F.round((most - least) * F.log(most / least), 9).desc(), "word").limit(FIT_WORDS).select("word").collect()
    words = {bytes(r["word"]): len(SHAPES) + k for k, r in enumerate(chosen)}

    def placed(batches):
        for batch in batches:
            rows = batch.to_pydict()
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(rows["doc_id"], pa.int64()), "domain": pa.array(rows["domain"], pa.string()), "at": pa.array([marks + sorted(words[w] for w in own if w in words) for own, marks in zip(rows["words"], rows["shapes"], strict=True)], pa.list_(pa.int32()))})

    got = seen.mapInArrow(placed, "doc_id long, domain string, at array<int>").toArrow().sort_by([("doc_id", "ascending"), ("domain", "ascending")])
    y = np.array([domains.index(d) for d in got["domain"].to_pylist()], int)
    x = np.zeros((len(y), len(SHAPES) + len(words) + 1), np.float32)
    x[:, -1] = 1
    for i, at in enumerate(got["at"].to_pylist()):
        x[i, at] = 1
    target = np.eye(len(domains), dtype=np.float32)[y]
    weights, speed = np.zeros((x.shape[1], len(domains)), np.float32), np.zeros((x.shape[1], len(domains)), np.float32)
    square = np.full_like(weights, 1e-8)
    for step in range(1, 301):  # Adam over the whole sample
        e = np.exp((z := x @ weights) - z.max(1, keepdims=True))
        slope = x.T @ (e / e.sum(1, keepdims=True) - target) / len(y) + 1e-3 * weights
        speed, square = 0.9 * speed + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights = weights - 0.05 * (speed / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return Classifier(domains, words, weights.astype(np.float64))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, p) of every document, p in the order of the model's domains. A null text has no tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(rows: dict) -> dict:
            seen = [look(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_tokens": [s[0] for s in seen], "p": list(sent.value.posteriors(seen))}

        return step

    return map_chunks(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, p array<double>")


def rates_after(p: np.ndarray, history: list[np.ndarray], pull: float, max_rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates, and the point that the next step looks at, after the slopes of the totals so far: accelerated gradient, projected on [0, max_rate]."""
    rate = look_at = np.ones(len(p))
    t = 1.0
    for slope in history:
        new = np.clip(look_at - (p @ slope + pull * (look_at - 1)) / (1 + pull), 0, max_rate)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look_at = new + (last - 1) / t * (new - rate)
        rate = new
    return rate, look_at


@dataclass
class Mix:
    """What fixes every document's rate: the slopes of all steps, and how far the totals ended from the targets."""

    domains: tuple[str, ...]
    history: list[np.ndarray]
    pull: float
    max_rate: float
    totals: dict[str, float]
    targets: dict[str, float]
    converged: bool = True

    def report(self, spark: SparkSession) -> DataFrame:
        """(domain, target, total, gap, steps, converged): expected tokens wanted and reached, and the gap as a share of all wanted."""
        wanted = sum(self.targets.values()) or 1.0
        rows = [(d, self.targets[d], self.totals[d], (self.totals[d] - self.targets[d]) / wanted, len(self.history), self.converged) for d in self.domains]
        return spark.createDataFrame(rows, "domain string, target double, total double, gap double, steps int, converged boolean")

    def rates(self, p: np.ndarray) -> np.ndarray:
        return rates_after(p, self.history, self.pull, self.max_rate)[0]


def fit_rates(scored: DataFrame, domains: tuple[str, ...], weights: dict[str, float], budget: float | str = 1.0, max_rate: float = MAX_RATE, steps: int = STEPS, pull: float = PULL) -> Mix:
    """Rates whose expected totals are ``weights`` of the budget, a multiple of all tokens.

    A budget "keep:<domain>" is the one at which that domain's own tokens are a twentieth short of its share, so that with max_rate 1 its
    documents stay at rate 1 and the others are thinned: the shares of the others are met, this domain's total stays short by that
    twentieth, which ``Mix.report`` shows. Without tokens every rate is 1.
    """
    share = np.array([weights[d] for d in domains], float)
    share = share / share.sum()

    size = len(domains)

    def summed(of) -> np.ndarray:
        """Sum over all documents of ``of(n, p)``, a fixed number of values; added up in each task, then by Spark."""

        def run(batches):
            out = 0.0
            for batch in batches:
                if batch.num_rows:
                    out = out + of(batch["n_tokens"].to_numpy(), batch["p"].flatten().to_numpy().reshape(batch.num_rows, -1))
            if not np.isscalar(out):
                yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(out)), pa.int32()), "v": pa.array(out)})

        found = scored.select("n_tokens", "p").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(found, key=lambda r: r["k"])] or [0.0] * (size + size * size))

    def totals(history: list[np.ndarray], which: int) -> np.ndarray:
        return summed(lambda n, p: (rates_after(p, history, pull, max_rate)[which] * n) @ p)

    first = summed(lambda n, p: np.concatenate([n @ p, ((p * n[:, None]).T @ p).ravel()]))
    now, moments = first[:size], first[size:].reshape(size, size)
    tokens = now.sum()
    if tokens == 0:
        return Mix(domains, [], pull, max_rate, dict.fromkeys(domains, 0.0), dict.fromkeys(domains, 0.0))
    if isinstance(budget, str):
        k = domains.index(budget.partition(":")[2])
        budget = 1.05 * now[k] / tokens / share[k]
    target = share * budget
    inverse = np.linalg.inv(moments / tokens + 1e-6 * np.eye(size))
    history: list[np.ndarray] = []
    converged = False
    while not converged and len(history) < steps:
        history.append(inverse @ ((totals(history, 1) if history else now) / tokens - target))
        converged = len(history) > 2 and float(np.abs(history[-1] - history[-2]).max()) < 1e-4
    end = totals(history, 0)
    return Mix(domains, history, pull, max_rate, dict(zip(domains, end.tolist(), strict=True)), dict(zip(domains, (target * tokens).tolist(), strict=True)), converged)


def dither(doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) fixed by the id: a document of rate r is taken floor(r + this) times."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit("take")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def solved(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | str, max_rate: float, fit_docs: int = FIT_DOCS) -> tuple[Classifier, DataFrame, Mix]:
    """The classifier, the scored documents (doc_id, n_tokens, p) and the fitted rates."""
    model = fit_classifier(docs, labels.select("doc_id", domain_of().alias("domain")), fit_docs=fit_docs)
    scored = save(score(docs, model), "mix-posteriors")
    return model, scored, fit_rates(scored, model.domains, weights, budget, max_rate)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, budget: float | str = 1.0, max_rate: float = MAX_RATE, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate, copies) of every document.

    Repeated rows are documents of their own; null and empty texts have no tokens; rows of ``labels`` without a label, or for unknown
    documents, teach nothing. Without any labelled document the posteriors are uniform. An empty table gives no rows.
    """
    model, scored, found = solved(docs, labels, weights, budget, max_rate, fit_docs)

    def make():
        return lambda rows: rows | {"rate": found.rates(np.array(rows["p"]).reshape(len(rows["p"]), -1)).tolist()}

    rated = map_chunks(scored, make, "doc_id long, n_tokens long, p array<double>, rate double", rows=8192)
    columns = [F.element_at("p", k + 1).alias(f"p_{d}") for k, d in enumerate(model.domains)]
    return rated.select("doc_id", "n_tokens", *columns, "rate", F.floor(F.col("rate") + dither()).cast("long").alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | str, max_rate: float, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``docs`` with all its columns, each row as often as its rate says; texts are scored again in place rather than joined.

    Null and empty texts have no tokens and a rate like others; rows of a null doc_id draw alike; an empty table stays empty.
    """
    model, _, found = solved(docs, labels, weights, budget, max_rate, fit_docs)
    sent = docs.sparkSession.sparkContext.broadcast((model, found))
    draw = "draw"
    while draw in docs.columns:
        draw += "_"

    def make():
        model, found = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen = [look(t) for t in batch["text"].to_pylist()]
            copies = np.floor(found.rates(model.posteriors(seen)) + batch[draw].to_numpy()).astype(np.int64)
            return batch.drop_columns([draw]).take(pa.array(np.repeat(np.arange(len(seen)), copies)))

        return step

    return map_slices(docs.withColumn(draw, dither()), make, docs.schema)
