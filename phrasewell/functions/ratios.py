"""Classifier ratios; an empty denominator gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def accuracy(correct: Column, count: Column) -> Column:
    return F.try_divide(correct.cast("double"), count)


def precision(tp: Column, fp: Column) -> Column:
    return F.try_divide(tp.cast("double"), tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return F.try_divide(tp.cast("double"), tp + fn)


def f1(p: Column, r: Column) -> Column:
    return F.try_divide(2 * p * r, p + r)
