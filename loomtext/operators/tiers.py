"""Scores from callables that hold a model, and tiers of them of which an expensive one sees only the rows inside its gate.

A Scorer says how its model is made, and how texts are scored with it. A Python worker makes a model at the first text that needs it and
keeps it for its later tasks; a worker that sees no such text never makes it. Texts go to the model in calls of a bounded number.

`scored` is one pass: rows outside the gate hand over a null instead of their text, and nulls are never given to the model. `dealt` is for
models that take far longer than a shuffle: rows inside the gate often lie in few partitions, so it deals them out anew and unites them
with the rest.

Cases: a null text has no score; a text whose scoring fails has none either and tells why in `error`, as long as the model itself can be
made; a null gate is closed; repeated rows are scored each; an empty table gives an empty result; other columns pass unchanged.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from loomtext.functions import constants as C
from loomtext.functions import scoring

RESULT = "score double, label string, features map<string,double>, error string"
_RESULT = pa.struct([("score", pa.float64()), ("label", pa.string()), ("features", pa.map_(pa.string(), pa.float64())), ("error", pa.string())])


@dataclass(frozen=True)
class Scorer:
    """load makes a model; score takes it and some texts and returns (score, label, features or None) for each."""

    name: str
    load: Callable[[], Any]
    score: Callable[[Any, list[str]], list[tuple]]
    #: Texts of one call.
    together: int = 64
    #: Whether a worker drops its other models before it makes this one.
    alone: bool = False
    #: What is called for each score that was computed, for counters.
    counted: Callable[[int], None] | None = field(default=None, compare=False)


_models: dict[str, Any] = {}


def model(scorer: Scorer) -> Any:
    """The worker's model, made now if it is not there yet."""
    if scorer.name not in _models:
        if scorer.alone:
            release()
        _models[scorer.name] = scorer.load()
    return _models[scorer.name]


def loaded(name: str) -> Any:
    """The worker's model, or an error if it was not made or has been dropped."""
    if name not in _models:
        raise RuntimeError(f"model {name} is not loaded in this process: score a text with its Scorer first")
    return _models[name]


def release(*names: str) -> None:
    """Drops the named models of this process, all if none is named; a model's close() is called if it has one."""
    for name in names or tuple(_models):
        found = _models.pop(name, None)
        if callable(getattr(found, "close", None)):
            found.close()
    gc.collect()


def _called(scorer: Scorer, texts: list[str]) -> list[tuple]:
    """Results of some texts, with None for error where there is one: a call that fails is repeated text by text."""
    held = model(scorer)
    try:
        found = [(*row, None) for row in scorer.score(held, texts)]
        if len(found) != len(texts):
            raise ValueError(f"{scorer.name} gave {len(found)} scores for {len(texts)} texts")
    except Exception as e:
        if len(texts) > 1:
            return [row for t in texts for row in _called(scorer, [t])]
        return [(None, None, None, f"{type(e).__name__}: {e}")]
    if scorer.counted:
        scorer.counted(len(texts))
    return found


def score_column(scorer: Scorer, text: Column) -> Column:
    """A struct of score, label, features and error for each text that is not null."""

    @arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list = [None] * len(batch)
            there = [k for k, ok in enumerate(batch.is_valid().to_pylist()) if ok]
            for start in range(0, len(there), scorer.together):
                part = there[start : start + scorer.together]
                for k, (score, label, features, error) in zip(part, _called(scorer, [batch[k].as_py() for k in part]), strict=True):
                    out[k] = {"score": score, "label": label, "features": None if features is None else list(features.items()), "error": error}
            yield pa.array(out, _RESULT)

    return run(text)


def scored(df: DataFrame, scorer: Scorer, text: str = "text", gate: Column | None = None, into: str | None = None) -> DataFrame:
    """Adds the struct column `into` (by default the scorer's name), null outside the gate."""
    source = F.col(text) if gate is None else F.when(gate, F.col(text))
    return df.withColumn(into or scorer.name, score_column(scorer, source))


def dealt(df: DataFrame, scorer: Scorer, tasks: int, text: str = "text", gate: Column | None = None, into: str | None = None) -> DataFrame:
    """The same rows as `scored`, in other partitions: those inside the gate are dealt to so many tasks. df is read twice, so it should be
    a table or a checkpoint."""
    inside = F.lit(True) if gate is None else F.coalesce(gate, F.lit(False))
    name = into or scorer.name
    some = scored(df.filter(inside).repartition(tasks), scorer, text, None, name)
    return some.unionByName(df.filter(~inside).withColumn(name, F.lit(None).cast(some.schema[name].dataType)))


def ensemble(first: Column, second: Column, third: Column, human_max: float = C.HUMAN_MAX, ai_min: float = C.AI_MIN) -> tuple[Column, Column]:
    """Score and class of up to three tiers; the weights depend on whether the third one is there."""
    score = F.when(third.isNotNull(), scoring.ensemble([first, second, third], C.WEIGHTS_ALL)).otherwise(scoring.ensemble([first, second], C.WEIGHTS))
    return score, scoring.label(score, human_max, ai_min)


def detected(df: DataFrame, third: Scorer, first: str = "first_score", second: str = "stat_score", text: str = "text", always: bool = False, human_max: float = C.HUMAN_MAX, ai_min: float = C.AI_MIN, tasks: int | None = None) -> DataFrame:
    """Adds gated, the third scorer's column, ensemble_score and classification.

    The third tier sees the texts that the first two leave open, strictly between the thresholds, or all of them with `always`. With
    `tasks` these are dealt out anew.
    """
    gate = scoring.needs_third_tier(F.col(first), F.col(second), always, human_max, ai_min)
    df = df.withColumn("gated", F.coalesce(gate, F.lit(False)))
    out = scored(df, third, text, F.col("gated")) if tasks is None else dealt(df, third, tasks, text, F.col("gated"))
    score, kind = ensemble(F.col(first), F.col(second), F.col(f"{third.name}.score"), human_max, ai_min)
    return out.withColumn("ensemble_score", score).withColumn("classification", kind)


def detections(samples: DataFrame, scorer: Scorer) -> DataFrame:
    """Detection records of samples (sample_id, text): record_id, sample_id, detector_name, score, predicted_label and features. A record's
    id follows from the sample and the detector, so a repeated run gives the same records."""
    found = F.col(scorer.name)
    digest = F.sha2(F.concat_ws("\n", F.col("sample_id"), F.lit(scorer.name)), 256)
    out = scored(samples.select("sample_id", "text"), scorer)
    return out.select(
        F.concat(F.lit("det_"), F.substring(digest, 1, 16)).alias("record_id"), "sample_id", F.lit(scorer.name).alias("detector_name"),
        found["score"].alias("score"), found["label"].alias("predicted_label"), found["features"].alias("features"), found["error"].alias("error"),
    )
