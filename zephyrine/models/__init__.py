"""Regression backends with one interface: ``fit`` returns a model with ``features`` and ``transform``."""

from .base import LinearModel, MLModel, PythonModel, detect_backend, extract_features, feature_importance, load_model, model_hash, predict, save_model
from .train import automl_leaderboard, build_model, train_model

__all__ = ["LinearModel", "MLModel", "PythonModel", "automl_leaderboard", "build_model", "detect_backend", "extract_features", "feature_importance", "load_model", "model_hash", "predict", "save_model", "train_model"]
