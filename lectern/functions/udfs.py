"""Functions on texts as vectorised columns and table functions; for what the engine's own functions can't express."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lectern.functions import machines as M
from lectern.functions import segments as S

_FINDINGS = T.StructType([T.StructField("text", T.StringType()), T.StructField("findings", T.LongType()), T.StructField("confidence", T.DoubleType())])


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts by their matching blocks; null counts as empty."""
    return pd.Series([S.seq_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts by insertions and deletions, of 100; null counts as empty."""
    return pd.Series([S.indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.StringType())
def ascii_fold(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else S.ascii_fold(t))


@F.pandas_udf(T.StringType())
def rewrite_terms(x: pd.Series) -> pd.Series:
    """Misheard terms rewritten; null stays null."""
    return x.map(lambda t: None if t is None else S.rewrite_terms(t))


@F.pandas_udf(_FINDINGS)
def clean_repetitions(x: pd.Series) -> pd.DataFrame:
    """Each text on its own without repetitions; a null text is empty."""
    rows = [S.repetitions(t or "") for t in x]
    return pd.DataFrame(rows, columns=["text", "findings", "confidence"])


def filter_profanity(level: str = "MODERATE", strategy: str = "BEEP", words: list[str] | None = None, compat: bool = False):
    """A column function: text, findings and confidence of the filter; a null text is empty."""

    @F.pandas_udf(_FINDINGS)
    def run(x: pd.Series) -> pd.DataFrame:
        rows = [(out, len(found), sure) for out, found, sure in (S.filter_profanity(t or "", level, strategy, "", words, compat) for t in x)]
        return pd.DataFrame(rows, columns=["text", "findings", "confidence"])

    return run


class Sentences:
    def eval(self, text: str) -> Iterator[tuple]:
        for k, s in enumerate(S.sentences(text or "")):
            yield k, s["text"], s["state"], s["confidence"], s["word_count"]


class Tokens:
    def eval(self, text: str) -> Iterator[tuple]:
        for k, (piece, word) in enumerate(S.pieces(text or "")):
            if word:
                yield k, piece


#: Machines that SQL can run, by name, and what their argument is made of.
MACHINES = {
    "segment_cleaner": (M.SegmentCleaner, str), "bounded_buffer": (M.BoundedBuffer, int), "rate_limiter": (M.RateLimiter, float), "moving_mean": (M.MovingMean, None),
    "word_window": (M.WordWindow, int),
}


class RunMachine:
    """``run_machine(TABLE (...) PARTITION BY stream ORDER BY (place), 'name', 'argument')``: the columns of any table with
    what a machine puts out for each row. The result's columns depend on both, so they are found when a query is
    analysed. Each stream begins anew."""

    #: What the machines put out; ``register`` fills it, as a schema is parsed by the engine.
    schemas: dict[str, T.StructType] = {}

    @classmethod
    def _columns(cls, rows: AnalyzeArgument, machine: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        if machine.value not in cls.schemas:
            raise ValueError(f"no such machine: {machine.value}")
        return AnalyzeResult(T.StructType([*rows.dataType.fields, *cls.schemas[machine.value].fields]))

    def __init__(self):
        self.machine = self.state = None

    def eval(self, row, machine: str, option: str) -> Iterator[tuple]:
        if self.machine is None:
            kind, of = MACHINES[machine]
            self.machine = kind() if of is None else kind(of(option))
            self.state = self.machine.start()
        for made in self.machine.step(self.state, row):
            yield *row, *made


def register(spark: SparkSession) -> None:
    """All of these by name in SQL: the functions, and the table functions ``sentences``, ``tokens`` and ``run_machine``."""

    class Run(RunMachine):
        schemas = {name: T._parse_datatype_string(kind.schema) for name, (kind, _) in MACHINES.items()}

        @staticmethod
        def analyze(rows: AnalyzeArgument, machine: AnalyzeArgument, option: AnalyzeArgument) -> AnalyzeResult:
            return Run._columns(rows, machine)

    spark.udtf.register("run_machine", F.udtf(Run))
    for f in (seq_ratio, indel_ratio, ascii_fold, rewrite_terms, clean_repetitions):
        spark.udf.register(f.__name__, f)
    spark.udf.register("filter_profanity", filter_profanity())
    spark.udtf.register("sentences", F.udtf(Sentences, returnType="pos int, text string, state string, confidence double, word_count int"))
    spark.udtf.register("tokens", F.udtf(Tokens, returnType="pos int, token string"))
