"""Comma-separated text with quotes, cut into rows and cells by expressions.

Whether a comma or a line end counts depends on the quotes before it, so a text
is cut at its quotes: even pieces are outside, odd ones inside, and an empty piece
outside, between two others, is a doubled quote.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Noncharacters that stand for cell and row ends; texts cannot have them, so theirs become replacement characters.
_CELL, _ROW, _LOST = "﷐", "﷑", "�"


def rows_of(text: Column) -> Column:
    """The rows of a text as arrays of cells; null if a quote stays open.

    A byte order mark and carriage returns outside quotes go; commas, line ends
    and doubled quotes inside quotes are data; quotes may open anywhere in a cell.
    """
    # The line end that is added keeps the last piece from looking like a doubled quote.
    plain = F.concat(F.translate(F.regexp_replace(text, "^\ufeff", ""), _CELL + _ROW, _LOST * 2), F.lit("\n"))
    pieces = F.split(plain, '"', -1)

    def read(piece: Column, i: Column) -> Column:
        outside = F.translate(F.replace(piece, F.lit("\r")), ",\n", _CELL + _ROW)
        return F.when(i % 2 == 1, piece).when((piece == "") & (i > 0), '"').otherwise(outside)

    lines = F.split(F.array_join(F.transform(pieces, read), ""), _ROW, -1)
    ended = F.try_element_at(lines, F.lit(-2)) == ""
    rows = F.slice(lines, 1, F.size(lines) - F.when(ended, 2).otherwise(1))
    return F.when(F.size(pieces) % 2 == 1, F.transform(rows, lambda r: F.split(r, _CELL, -1)))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s﻿]+|[\s﻿]+$", "")
