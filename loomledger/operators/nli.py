"""Entailment: the contract of a pair scorer and its deterministic stand-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomledger.functions.text import content_words, is_number


def stand_in(premise: Column | str, hypothesis: Column | str) -> Column:
    """struct<entailment, neutral, contradiction> by words.

    A hypothesis without content words is neutral. Where it holds a number that the premise lacks, the premise holds numbers too, and at
    least 60 % of its other words (all of none) are in the premise, it is contradicted. Else it is entailed by the share of its words in the premise.
    """
    return of_words(content_words(premise), content_words(hypothesis))


def of_words(p: Column, h: Column) -> Column:
    """The same over content words. Give columns that hold them: each is read several times."""
    other, figures = F.filter(h, lambda w: ~is_number(w)), F.filter(h, is_number)
    shared = F.size(F.array_intersect(h, p))
    changed = (F.size(F.array_except(figures, p)) > 0) & (F.size(F.filter(p, is_number)) > 0) & (F.size(F.array_intersect(other, p)) >= 0.6 * F.size(other))
    score = lambda e, n, c: F.struct(e.alias("entailment"), n.alias("neutral"), c.alias("contradiction"))
    zero, one = F.lit(0.0), F.lit(1.0)
    share = shared / F.size(h)
    return F.when(F.size(h) == 0, score(zero, one, zero)).when(changed, score(zero, zero, one)).otherwise(score(share, one - share, zero))
