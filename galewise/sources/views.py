"""The inputs as named views, so that jobs can be written as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galewise.sources import tables

NAMES = [
    "station_obs", "forecast_files", "forecast_grid", "sim_matrix", "video_embedding", "course_platform",
    "course", "course_documents", "course_sim", "watch_history", "sort_sample", "ranking_lines", "penguins",
    "abalone", "tree_nodes", "tree_inputs", "calibration", "triples", "table_names",
]


def register_views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> list[str]:
    """Register inputs of a data folder as temporary views and return their names."""
    names = names or NAMES
    for name in names:
        getattr(tables, name)(spark, sf_dir).createOrReplaceTempView(name)
    return names


def register_nce_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored pair sample and target mapping as views."""
    sample, mapping = tables.sim_matrix_nce(spark, sf_dir)
    sample.createOrReplaceTempView("sim_matrix_sample_nce")
    mapping.createOrReplaceTempView("sim_matrix_mapping_nce")
    return sample, mapping
