"""Where a model is called: batches of rows, one client a task, answers cached by key so that a row is asked once.

The deterministic doubles stand for the model in tests and dry runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from evidentia.operators.iterate import save

#: Claims of one extraction call, rows of one judge or embedding call.
CLAIMS_A_CALL, ROWS_A_CALL = 20, 8
#: A client takes a batch of rows as dictionaries and gives one value, or dictionary of values, for each.
Client = Callable[[list[dict]], list]


def answered(rows: DataFrame, answer: str, client: Callable[[], Client], batch: int = ROWS_A_CALL, calls: Accumulator | None = None) -> DataFrame:
    """``rows`` with the columns of ``answer`` (a DDL schema), asked in batches; ``client()`` runs once a task. ``calls`` counts the calls, those of a task run again too."""
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(answer).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        ask, arrow = client(), to_arrow_schema(schema)
        for rows_ in batches:
            for at in range(0, rows_.num_rows, batch):
                part = rows_.slice(at, batch).to_pylist()
                if calls is not None:
                    calls.add(1)
                yield pa.RecordBatch.from_pylist([r | a for r, a in zip(part, ask(part), strict=True)], arrow)

    return rows.mapInArrow(run, schema)


def cached(
    rows: DataFrame, key: list[str], path: str, answer: str, client: Callable[[], Client], batch: int = ROWS_A_CALL, calls: Accumulator | None = None, fetched: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``rows`` with their answers from the cache at ``path`` (key and answer); keys that it lacks are asked first, each once, and appended.

    ``fetched`` adds to the rows that are asked what the client looks at, so that ``rows`` need not carry it: texts travel only where a model reads them.
    The append is one commit, so a failed fill leaves the cache as it was. Where two fills met, a key may stand there twice; the smaller answer counts.
    Rows with a null in the key are not asked and get nulls.
    """
    spark, names = rows.sparkSession, T.StructType.fromDDL(answer).names

    def known() -> DataFrame | None:
        try:
            found = spark.read.parquet(path)
        except AnalysisException:
            return None
        return found.groupBy(*key).agg(F.min(F.struct(*names)).alias("_a")).select(*key, "_a.*")

    asked = [c for c in rows.columns if c not in names]
    wanted, had = rows.select(*asked).dropna(subset=key), known()
    if had is not None:
        wanted = wanted.join(had.select(*key), key, "left_anti")
    # dealt first, or each task would sort its part of the input to drop duplicates there
    missing = save(wanted.repartition(*key).dropDuplicates(key), "asked")
    if had is None or not missing.isEmpty():
        missing = fetched(missing) if fetched else missing
        answered(missing, answer, client, batch, calls).select(*key, *names).write.mode("append").parquet(path)
    return rows.select(*asked).join(known(), key, "left")


def marker_client(lexicon: list[tuple[str, str]]) -> Client:
    """The double of the extractor: a surface is found where the lower-case text holds it."""

    def ask(claims: list[dict]) -> list:
        return [[(s, t) for s, t in lexicon if s.lower() in (c["text"] or "").lower()] for c in claims]

    return ask


@udtf
class MentionFinder:
    """One claim to its mentions, as a table function: ``MentionFinder(claims.asTable().partitionBy(...).orderBy("claim_id"), lit(lexicon))``.

    The table has claim_id and text; claims of a partition go to the extractor in calls of ``CLAIMS_A_CALL``, which are numbered. The lexicon is JSON, a list of
    [surface, type]. A surface counts once a type and claim, the first one stands. The columns by which the table is partitioned are not returned.
    """

    @staticmethod
    def analyze(claims: AnalyzeArgument, lexicon: AnalyzeArgument) -> AnalyzeResult:
        names = {f.name for f in claims.dataType} if claims.isTable else set()
        if not {"claim_id", "text"} <= names:
            raise ValueError("the first argument has to be a table with claim_id and text")
        kind = next(f.dataType for f in claims.dataType if f.name == "claim_id")
        return AnalyzeResult(T.StructType().add("claim_id", kind).add("place", T.IntegerType()).add("surface", T.StringType()).add("surface_key", T.StringType()).add("entity_type", T.StringType()))

    def __init__(self) -> None:
        self.waiting: list[dict] = []
        self.client: Client | None = None

    def eval(self, claims, lexicon: str):
        self.client = self.client or marker_client([tuple(x) for x in json.loads(lexicon)])
        self.waiting.append({"claim_id": claims["claim_id"], "text": claims["text"]})
        if len(self.waiting) == CLAIMS_A_CALL:
            yield from self.called()

    def terminate(self):
        if self.waiting:
            yield from self.called()

    def called(self):
        asked, self.waiting = self.waiting, []
        for claim, mentions in zip(asked, self.client(asked), strict=True):
            seen: set[tuple[str, str]] = set()
            for surface, kind in mentions:
                key = " ".join(surface.lower().split())
                if key and (kind, key) not in seen:
                    seen.add((kind, key))
                    yield claim["claim_id"], len(seen), surface, key, kind


def found_mentions(claims: DataFrame, lexicon: list[tuple[str, str]], parts: int = 64) -> DataFrame:
    """(claim_id, place, surface, surface_key, entity_type) of claims (subject_id, claim_id, text): a subject's claims are dealt into ``parts``, so that none is one task."""
    rows = claims.select("subject_id", F.pmod(F.xxhash64("claim_id"), F.lit(parts)).alias("part"), "claim_id", "text")
    return MentionFinder(rows.asTable().partitionBy("subject_id", "part").orderBy("claim_id"), F.lit(json.dumps(lexicon)))
