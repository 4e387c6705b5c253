"""Operation counts of network layers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def conv(in_channels: Column, groups: Column, kernel: Column, out_elements: Column) -> Column:
    """Also of transposed ones; kernel: number of its elements, out_elements: all elements of the result."""
    return 2 * F.floor(in_channels / groups).cast("long") * kernel * out_elements


def linear(in_features: Column, out_elements: Column) -> Column:
    return 2 * in_features * out_elements


def norm(elements: Column) -> Column:
    return 4 * elements


def activation(elements: Column) -> Column:
    return elements


def gelu(elements: Column) -> Column:
    return 8 * elements


def attention(batch: Column, sequence: Column, width: Column) -> Column:
    return batch * (4 * sequence * sequence * width + 8 * sequence * width * width)
