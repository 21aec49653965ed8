"""Encounters as they arrive: intake and the decision against frozen cut-points, by the batch expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.constants import VITAL_RANGES
from ..operators.abstain import decide


def stream_clean(raw: DataFrame) -> DataFrame:
    """Walk-in records as text to typed, repaired, clipped vitals with missing bits; stateless."""
    vit = [c for c in VITAL_RANGES if c in raw.columns]
    df = raw.withColumns({c: C.num(c) for c in vit} | {"sex": C.norm_sex("sex"), "glucose_type": C.default_na("glucose_type", True), "smoker_flag": C.smoker_flag("smoker")})
    df = df.withColumns({"blood_glucose": C.harmonise_glucose("blood_glucose"), "temperature": C.harmonise_temperature("temperature")})
    return C.missing_panel(C.clip_ranges(df), vit)


def stream_decide(scored: DataFrame, policy: DataFrame, mode: str = "global") -> DataFrame:
    """Scored encounters (component, confidence, sparse) with cover; joins the stream to the static policy."""
    return decide(scored, policy, mode)


def stream_score(rows: DataFrame, model, policy: DataFrame, mode: str = "global") -> DataFrame:
    """A fitted pyspark.ml model on rows with component and sparse, then the decision. The model's probability of the
    second class is the confidence, unless it gives a column of that name itself."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows)
    if "confidence" not in scored.columns:
        scored = scored.withColumn("confidence", vector_to_array("probability")[1])
    return stream_decide(scored, policy, mode)


def serve(stream: DataFrame, model, policy: str, path: str, checkpoint: str, columns: list[str], mode: str = "global"):
    """Score and decide what a stream holds now, and write the columns as Parquet, a folder per micro-batch.

    The policy is read anew from its Parquet path in each micro-batch, so cut-points that are frozen again hold from the
    next one on. A micro-batch that is repeated after a stop overwrites its own folder, and the checkpoint
    knows which input is done: no row is lost or doubled."""

    def one(batch: DataFrame, batch_id: int) -> None:
        frozen = batch.sparkSession.read.parquet(policy)
        stream_score(batch, model, frozen, mode).select(*columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_once(df: DataFrame, path: str, checkpoint: str):
    """Write what a stream holds now as Parquet, exactly once per checkpoint."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
