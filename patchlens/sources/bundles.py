"""Saved model bundles: assembler, scaler and classifier travel together."""

from __future__ import annotations

from pyspark.ml import PipelineModel


def save_bundle(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_bundle(path: str) -> PipelineModel:
    """A missing bundle raises the reader's error."""
    return PipelineModel.load(path)
