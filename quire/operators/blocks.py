"""8 by 8 blocks: forward cosine transform and quantisation as array expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The orthonormal cosine basis, term by term: cell 8u + x.
BASIS = [math.cos((2 * x + 1) * u * math.pi / 16) * math.sqrt((1 if u == 0 else 2) / 8) for u in range(8) for x in range(8)]
_BASIS = "array(" + ",".join(f"{v!r}D" for v in BASIS) + ")"


def _pass(column: str, cell: str) -> str:
    """64 sums of eight products; cell is the index of the x-th input of output i."""
    return f"transform(sequence(0, 63), i -> aggregate(sequence(0, 7), 0D, (s, x) -> s + {column}[{cell}] * {_BASIS}[(i % 8) * 8 + x]))"


def cosine_terms(blocks: DataFrame, block: str) -> DataFrame:
    """block: array of 64 numbers, row by row -> `terms`: its 64 cosine terms, row by row. Two separable passes, no Python.

    Each pass is bound to a lambda's variable: a column used inside a lambda would be computed for each cell.
    """
    # The first pass transforms rows and leaves their terms in place; the second transforms columns, transposed.
    twice = f"transform(array({_pass(block, '(i div 8) * 8 + x')}), once -> {_pass('once', 'x * 8 + (i div 8)')})"
    straight = f"transform({twice}, twice -> transform(sequence(0, 63), i -> twice[(i % 8) * 8 + i div 8]))[0]"
    return blocks.withColumn("terms", F.expr(straight))


def quantised(blocks: DataFrame, terms: str, table: list[int]) -> DataFrame:
    """Terms divided by the table, rounded half away from zero, within 1023 (2047 for the first)."""
    steps = "array(" + ",".join(map(str, table)) + ")"
    limit = "if(i = 0, 2047, 1023)"
    return blocks.withColumn("quantised", F.expr(f"transform({terms}, (v, i) -> greatest(-{limit}, least({limit}, cast(round(v / {steps}[i]) as int))))"))
