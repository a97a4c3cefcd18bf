"""Words of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop list that results are defined with.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can
will just don should now
""".split()

# Characters that are taken out of words, and the class that splits reviews.
PUNCTUATION = "([,.!?:;])"
SPLITTERS = r"""[\s\n\d\$\%\(\[\,\.\!\?\:\;\]\)\'\-\"\~\\\*]"""


def plain_words(text: Column) -> Column:
    """Lower-cased, split at single spaces, without the punctuation characters; empty words remain."""
    return F.transform(F.split(F.lower(text), " "), lambda w: F.translate(w, PUNCTUATION, ""))


def review_words(text: Column) -> Column:
    """Lower-cased, split at white space, digits and punctuation; empty words remain."""
    return F.split(F.lower(F.trim(text)), SPLITTERS)


def is_stopword(word: Column) -> Column:
    return word.isin(STOPWORDS)


def stopwords_sql() -> str:
    return "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def categories(text: Column) -> Column:
    """A comma-separated list as trimmed names; null and empty have none."""
    return F.when(text.isNotNull() & (text != ""), F.transform(F.split(text, ","), lambda x: F.trim(x)))
