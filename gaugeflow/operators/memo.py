"""Comparators that ask a model, over whole tables: each distinct pair of values is asked about once, ever.

The distinct pairs of a table are anti-joined with a stored memo; what is new
is sent to the model in batches from the executors, with retries, and its
answers are appended to the memo. Scores are then a join. Values are told
apart by a hash of comparator, settings and texts of 256 bits. Distinct pairs
are found within each task before the shuffle, so one that a third of all
rows share is one row a task. A task that is lost asks its own batch again;
what other runs have answered is not asked again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import scalars as S
from ..plans.spec import FieldSpec, ModelSpec
from ..sources.stored import stored
from . import flat

#: Scores of a batch of pairs of texts, in their order.
Ask = Callable[[list[tuple[str, str]]], list[float]]
MEMO = "id string, score double, error string"
#: Over how many keys the rows of one id are dealt, see ``score``.
SALTS = 32


def with_retries(ask: Ask, pairs: list[tuple[str, str]], attempts: int, wait: float) -> tuple[list[float | None], str | None]:
    """Scores, or the error of the last attempt; waits grow twofold."""
    for attempt in range(attempts):
        try:
            found = [float(x) for x in ask(pairs)]
            if len(found) != len(pairs):
                raise ValueError(f"{len(found)} scores for {len(pairs)} pairs")
            return list(found), None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < attempts:
                time.sleep(wait * 2**attempt)
    return [None] * len(pairs), error


def identity(name: str, settings: dict, a: Column, b: Column) -> Column:
    """The id of a question: of a comparator, its settings and two texts; lengths keep ("ab", "c") and ("a", "bc") apart."""
    own = json.dumps([name, settings], sort_keys=True, default=str)
    return F.sha2(F.concat_ws("\x1f", F.lit(own), F.length(a).cast("string"), a, b), 256)


class Memo:
    """Answers of a model in a folder of Parquet files, which is only added to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        # An empty part, so that the folder can be read from the start.
        if not self._exists():
            spark.createDataFrame([], MEMO).write.mode("append").parquet(self.folder)

    def _exists(self) -> bool:
        try:
            self.spark.read.schema(MEMO).parquet(self.folder)
            return True
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return False
            raise

    def answers(self) -> DataFrame:
        """(id, score) of all that was answered. An id that two runs asked at once has the score of either, the smaller."""
        held = self.spark.read.schema(MEMO).parquet(self.folder).where("error is null")
        return held.groupBy("id").agg(F.min("score").alias("score"))

    def failures(self) -> DataFrame:
        """(id, error) of what had no answer when it was last asked; it is asked again at the next run."""
        held = self.spark.read.schema(MEMO).parquet(self.folder)
        return held.where("error is not null").join(self.answers(), "id", "left_anti").select("id", "error").distinct()

    def ask(self, questions: DataFrame, ask: Ask, batch: int, attempts: int, wait: float) -> None:
        """Asks what is not answered yet of ``questions`` (id, a, b; distinct) and keeps the answers."""
        new = questions.join(self.answers(), "id", "left_anti")

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for k in range(0, len(frame), batch):
                    part = frame.iloc[k : k + batch]
                    scores, error = with_retries(ask, list(zip(part["a"], part["b"])), attempts, wait)
                    yield pd.DataFrame({"id": part["id"], "score": pd.array(scores, dtype="Float64"), "error": error})

        new.mapInPandas(work, MEMO).write.mode("append").parquet(self.folder)


def score(df: DataFrame, memo: Memo, ask: Ask, a: str, b: str, to: str = "score", name: str = "model", settings: dict | None = None, batch: int = 64, attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """``df`` with the model's score of two text columns in ``to``, from the memo.

    Two nulls score 1, one null 0, and equal texts 1, without being asked
    about; so do not use it for a model to which equal texts are unlike. What
    the model did not answer, after ``attempts``, is null, and is in
    ``memo.failures()``. All rows of ``df`` stay, repeated ones too.

    Ids are dealt over ``SALTS`` keys each in the final join, the answers being
    repeated for them: a pair of values that a third of all rows hold is not
    one task's. Rows that are equal in every column share a key; those are
    left to Spark's skew join.
    """
    key, salt = f"~id{uuid.uuid4().hex[:8]}", f"~salt{uuid.uuid4().hex[:8]}"
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    open_ = x.isNotNull() & y.isNotNull() & (x != y)
    held = df.withColumn(key, F.when(open_, identity(name, settings or {}, x, y)))
    # One row for each question, whatever the number of rows that ask it.
    questions = held.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.first(x).alias("a"), F.first(y).alias("b"))
    memo.ask(questions, ask, batch, attempts, wait)
    # Rows without a question have no id to meet; their salt alone would put them into one task.
    spread = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not _is_map(df, c)]), F.lit(SALTS)))
    # Of this table's questions only, and as a table of its own: within one plan Spark takes two scans of one folder for the same,
    # even if files came in between.
    known = stored(questions.select("id").join(memo.answers(), "id"), "answers")
    answers = known.select(F.col("id").alias(key), F.col("score").alias(f"{key}s"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias(salt))
    asked = held.where(F.col(key).isNotNull()).withColumn(salt, spread).join(answers, [key, salt], "left")
    settled = held.where(F.col(key).isNull())
    given = F.when(x.isNull() & y.isNull(), 1.0).when(x.isNull() | y.isNull(), 0.0).otherwise(1.0)
    own = [f"`{c}`" for c in df.columns]
    return asked.select(*own, F.col(f"{key}s").alias(to)).unionByName(settled.select(*own, given.alias(to)))


def ask_of(comparator: S.Comparator) -> Ask:
    """A comparator as a function of a batch. Of an embedding comparator each distinct text of the batch is embedded once."""

    def ask(pairs: list[tuple[str, str]]) -> list[float]:
        return S.batch_scores(comparator, [a for a, _ in pairs], [b for _, b in pairs])

    return ask


def asked_fields(model: ModelSpec, prefix: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], FieldSpec]]:
    """The scalar fields, also of nested records, whose comparators have no native form: (names from the top, field)."""
    out = []
    for f in model.fields:
        if f.kind == "struct":
            out += asked_fields(f.model, (*prefix, f.name))
        elif not f.is_list and not f.is_map and not isinstance(f.comparator, (S.Exact, S.Levenshtein, S.Numeric, S.Fuzzy)):
            out.append(((*prefix, f.name), f))
    return out


def compare_records(pairs: DataFrame, model: ModelSpec, memo: Memo, gt: str = "expected", pred: str = "predicted", batch: int = 64, attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """The long relation of ``flat.compare_flat`` of records some of whose fields a model compares.

    Those fields are scored from the memo, the others natively. A field that
    is missing on a side is not asked about. What the model did not answer
    scores 0, and is in ``memo.failures()``. Questions are told apart by the
    comparator's name and settings, not by its functions: fields whose
    functions differ need memos of their own. Records without matched lists
    only. ``pairs`` has doc_id and the sides as structs, and rows that repeat
    stay.
    """
    given, held = {}, pairs.select("doc_id", gt, pred)
    for k, (names, f) in enumerate(asked_fields(model)):
        a, b = F.col(gt), F.col(pred)
        for n in names:
            a, b = a.getField(n), b.getField(n)
        # What is missing has its outcome without a score.
        text = lambda v: F.when(~C.is_empty_value(v), v.cast("string"))
        held = held.withColumns({f"~a{k}": text(a), f"~b{k}": text(b)})
        # Functions have no name that lasts; give each model a memo of its own.
        settings = {n: v for n, v in f.comparator.config().items() if not callable(v) and n != "threshold"}
        held = score(held, memo, ask_of(f.comparator), f"~a{k}", f"~b{k}", f"~score{k}", f.comparator.name, settings, batch, attempts, wait)
        given[".".join(names)] = f"~score{k}"
    return flat.compare_flat(held, model, gt, pred, documents=True, given=given)


def _is_map(df: DataFrame, column: str) -> bool:
    """Maps and variants have no hash."""
    return any(k in dict(df.dtypes)[column] for k in ("map<", "variant"))
