"""What both jobs measure of a text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortis.functions import texts

CLASSES = {"space": " \t\n\v\f\r", "digits": "0123456789", "marks": "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "breaks": "\n"}


def counted(text: Column) -> Column:
    """How many characters of each of CLASSES a text has, and `words`, the runs of characters other than space and \\x09-\\x0D; a
    null text has none. A struct: give it a name before its fields are used, so that a text is read once."""
    return texts.counts(text, CLASSES, "space")


def share(part: Column, chars: Column) -> Column:
    """The share of a text's characters that a class of characters holds; null for an empty text."""
    return 1 - F.try_divide(chars - part, chars)


def site_label(site: Column) -> Column:
    """A site as a folder's value: a null and an empty one apart, digits never taken for numbers."""
    return F.coalesce(F.concat(F.lit("s-"), site.cast("string")), F.lit("none"))
