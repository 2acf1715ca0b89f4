"""Text in, nearest past cases out."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.operators.cells import CellIndex, Layout
from casemesh.operators.features import as_array, featurize
from casemesh.operators.neighbours import k_nearest
from casemesh.session import materialize


def text_vectors(df: DataFrame, key: str, model: PipelineModel) -> DataFrame:
    """``key, embedding`` of ``complaint_text``, written, as sparse vectors, because joins read
    it repeatedly."""
    texts = df.where(F.col("complaint_text").isNotNull()).select(key, "complaint_text")
    kept = materialize(featurize(texts, model).select(key, "features"), "text-vectors")
    return kept.select(key, as_array(F.col("features")).alias("embedding"))


def similar_text(
    queries: DataFrame,
    index: DataFrame | CellIndex,
    model: PipelineModel,
    k: int = 2,
    *,
    query_id: str = "complaint_id",
    index_id: str = "id",
    metric: str = "cosine",
    layout: Layout = Layout(),
    nprobe: int | None = None,
    recall: float | None = None,
) -> DataFrame:
    """``query_id, rank, id, distance`` of the k cases nearest to each ``complaint_text``.

    ``index`` holds vectors of the same ``model``.
    """
    return k_nearest(
        text_vectors(queries, query_id, model), index, k, query_id=query_id,
        index_id=index_id, metric=metric, layout=layout, nprobe=nprobe, recall=recall,
    )
