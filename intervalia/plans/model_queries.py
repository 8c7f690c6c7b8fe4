"""Queries of fitted models; SQL cannot express them, tests compare them with brute force."""

from __future__ import annotations

from intervalia.operators import models
from intervalia.plans.registry import query
from intervalia.sources.fixtures import vectors


@query("a07_principal_components")
def a07(spark, d):
    return models.principal(vectors(spark, d))


@query("c17_codebook")
def c17(spark, d):
    return models.codebook(vectors(spark, d))


@query("c16_split_in_two")
def c16(spark, d):
    return models.halves(vectors(spark, d), [0, 1, 2, 3])[0]


@query("c16_diagnostic_dimensions")
def c16_dims(spark, d):
    return models.halves(vectors(spark, d), [0, 1, 2, 3])[1]
