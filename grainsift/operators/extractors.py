"""Names in texts, by a list or by an extractor of the caller's.

An extractor is a function of a batch of texts (a pandas Series without missing values) that gives, for each text in order,
the (entity type, term) pairs it finds. It runs in the tasks, is sent to them once, and may keep a model in a closure or build
one on first use. Finds are counted inside a batch, so a name found everywhere is one row per batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from grainsift.functions.text import words

try:
    import ahocorasick
except ImportError:             # lists are then matched by a join
    ahocorasick = None

Extractor = Callable[[pd.Series], Iterable[Iterable[tuple[str, str]]]]

#: names up to which a list is sent to all tasks; longer lists are joined
BROADCAST_NAMES = 200_000

FOUND_SCHEMA = "column_name string, entity_type string, term string, n_rows long"


def extract_entities(df: DataFrame, extractor: Extractor, columns: Sequence[str]) -> DataFrame:
    """Number of texts per column, entity type and term that the extractor finds; a text counts once per term."""
    return _counted(df.select(*columns).unpivot([], list(columns), "column_name", "text"), extractor)


def _counted(texts: DataFrame, extractor: Extractor) -> DataFrame:
    """``texts`` has ``column_name`` and ``text``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for column, part in batch.groupby("column_name")["text"]:
                for entities in extractor(part):
                    found.update({(column, kind, term) for kind, term in entities})
            rows = [(*key, n) for key, n in found.items()]
            yield pd.DataFrame(rows, columns=["column_name", "entity_type", "term", "n_rows"])

    return (texts.filter("text IS NOT NULL").mapInPandas(run, FOUND_SCHEMA)
            .groupBy("column_name", "entity_type", "term").agg(F.sum("n_rows").alias("n_rows")))


def spaced_words(text: Column) -> Column:
    """The lower-cased words of a text, each between single blanks."""
    return F.concat(F.lit(" "), F.array_join(words(F.lower(text)), " "), F.lit(" "))


def name_extractor(names: Sequence[tuple[str, str]]) -> Extractor:
    """Extractor for a list of (term, entity type) over texts prepared by ``spaced_words``: one automaton finds all names
    in a single run over the text, however long the list is."""
    def automaton():
        if "built" not in kept:
            built = ahocorasick.Automaton()
            by_term: dict[str, set[tuple[str, str]]] = {}
            for term, kind in names:
                by_term.setdefault(f" {term} ", set()).add((kind, term))
            for term, found in by_term.items():
                built.add_word(term, tuple(sorted(found)))
            if by_term:
                built.make_automaton()
            kept["built"] = built if by_term else None
        return kept["built"]

    kept: dict = {}

    def extract(texts: pd.Series) -> Iterator[list[tuple[str, str]]]:
        found = automaton()
        for text in texts:
            yield [] if found is None else [entity for _, entities in found.iter(text) for entity in entities]

    return extract


def listed_names(df: DataFrame, gazetteer: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """Texts per column and name of a list (``term``, ``entity_type``), or None where the list is too long to be sent along."""
    if ahocorasick is None:
        return None
    names = gazetteer.select(F.lower("term").alias("term"), "entity_type").filter("term IS NOT NULL").distinct()
    rows = names.limit(BROADCAST_NAMES + 1).collect()
    if len(rows) > BROADCAST_NAMES:
        return None
    texts = df.select(*columns).unpivot([], list(columns), "column_name", "text")
    return _counted(texts.select("column_name", spaced_words(F.col("text")).alias("text")),
                    name_extractor([(r["term"], r["entity_type"]) for r in rows]))
