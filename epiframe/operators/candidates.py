"""Candidate turns, prompts and label masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def best_candidate(formatting: Column, visual: Column, relevance: Column, weights: tuple[float, float, float] = (0.5, 0.5, 0.5)) -> Column:
    """Index from 0 of the candidate of greatest weighted score, the first among equals; null ratings count 0."""
    zero = lambda a: F.transform(a, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    add = lambda a, b, w: F.zip_with(a, b, lambda x, y: x + y * w)
    score = add(add(F.transform(zero(formatting), lambda x: x * weights[0]), zero(visual), weights[1]), zero(relevance), weights[2])
    return F.when(F.size(score) == 1, 0).otherwise(F.array_position(score, F.array_max(score)).cast("int") - 1)


def best_row(row: Column, turn: Column, formatting: Column, visual: Column, relevance: Column, weights: tuple[float, float, float] = (0.5, 0.5, 0.5)) -> Column:
    """The same over a group's rows, as an aggregate: the row of greatest score, of the first turn among equals. One row
    is held to a group, before the shuffle and after it."""
    rated = [F.coalesce(c.cast("double"), F.lit(0.0)) * w for c, w in zip((formatting, visual, relevance), weights)]
    return F.max_by(row, F.struct(rated[0] + rated[1] + rated[2], -turn))


def prompt(instruction: Column, n_states: Column, intrinsic: list[Column] | None = None) -> Column:
    """Task text, a placeholder to each state, and the camera's numbers with two digits."""
    text = F.concat(F.lit("Task: "), instruction, F.lit(" States: "), F.repeat(F.lit("<state>"), n_states))
    return F.concat(text, F.format_string(" fx:%.2f fy:%.2f cx:%.2f cy:%.2f", *intrinsic)) if intrinsic else text


def find_header(tokens: Column, header: list[str]) -> Column:
    """Places from 0 after each occurrence of header in tokens."""
    n = len(header)
    at = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
    same = lambda k: F.forall(F.array(*(F.coalesce(F.get(tokens, k + i) == h, F.lit(False)) for i, h in enumerate(header))), lambda x: x)
    return F.transform(F.filter(at, same), lambda k: k + n)


def answer_start(tokens: Column, header: list[str]) -> Column:
    """Place after the only occurrence; the length without one; several are an error."""
    found = find_header(tokens, header)
    many = F.raise_error(F.lit("several answer headers")).cast("int")
    return F.when(F.size(found) == 0, F.size(tokens)).when(F.size(found) == 1, F.get(found, 0)).otherwise(many)


def masked_labels(ids: Column, start: Column, pad: int, ignore: int = -100) -> Column:
    return F.transform(ids, lambda x, i: F.when((x == pad) | (i < start), ignore).otherwise(x))
