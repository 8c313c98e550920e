"""Helpers shared by the grouped-map kernels."""

from __future__ import annotations

import pandas as pd


def plain_strings(pdf: pd.DataFrame) -> pd.DataFrame:
    """Text columns as one plain array each; the Arrow-backed kind may come in several pieces,
    which the way back to Spark does not accept."""
    text = [c for c in pdf.columns if isinstance(pdf[c].dtype, pd.StringDtype)]
    return pdf.astype({c: object for c in text}) if text else pdf


def no_rows(columns: list[str]) -> pd.DataFrame:
    """An empty result that converts to any column types."""
    return pd.DataFrame(columns=columns, dtype=object)
