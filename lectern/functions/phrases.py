"""Occurrences of many phrases in texts: one automaton over all of them, so that a text is read once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def automaton(pairs: list[tuple[str, str]]):
    """Goto and failure links over the distinct aliases; each tells the places of its pairs in the list and its length."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for k, (alias, _) in enumerate(pairs):
        places.setdefault(alias, []).append(k)
    made = ahocorasick.Automaton()
    for alias, ks in places.items():
        made.add_word(alias, (len(alias), ks))
    made.make_automaton()
    return made


def located(pairs: list[tuple[str, str]]) -> Callable:
    """A column function: all occurrences (alias, term, at) of the pairs' aliases in a text, overlapping ones too, in the order of the pairs and then of their 0-based places.  The pairs go to every task: callers bound their size."""

    @F.pandas_udf("array<struct<alias:string,term:string,at:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = automaton(pairs)
        for texts in batches:
            out = []
            for text in texts:
                met = sorted((k, end - n + 1) for end, (n, ks) in made.iter(text or "") for k in ks)
                out.append([{"alias": pairs[k][0], "term": pairs[k][1], "at": at} for k, at in met])
            yield pd.Series(out)

    return find


def taken(made, pairs: list[tuple[str, str]], text: str) -> list[dict]:
    """For each pair in order its first occurrence outside the spans taken so far: (alias, term, at, stop).  As a text search goes, an occurrence that overlaps the one counted before it of the same alias is none."""
    out, full, last, after, hit = [], bytearray(len(text)), -1, 0, False
    for k, at in sorted((k, end - n + 1) for end, (n, ks) in made.iter(text) for k in ks):
        if k != last:
            last, after, hit = k, 0, False
        if hit or at < after:
            continue
        alias, term = pairs[k]
        after = at + len(alias)
        if full.find(1, at, after) < 0:
            full[at:after] = b"\1" * len(alias)
            hit = True
            out.append({"alias": alias, "term": term, "at": at, "stop": after})
    return out


def first_free(pairs: list[tuple[str, str]]) -> Callable:
    """A column function: what is `taken` of a text.  The pairs go to every task: callers bound their size."""

    @F.pandas_udf("array<struct<alias:string,term:string,at:int,stop:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = automaton(pairs)
        for texts in batches:
            yield pd.Series([taken(made, pairs, text or "") for text in texts], dtype=object)

    return find


#: Texts whose hits are held at once.
AT_ONCE = 1_000


def block_hits(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of texts and `h`, what is `taken` of each.

    rows: block, alias, term and the columns; within a block, which lies in one
    partition, first the pairs in the order of search, then its texts (null alias).
    A task holds the pairs of one block and reads its texts as they come.
    """
    spans = pa.list_(pa.struct([("alias", pa.string()), ("term", pa.string()), ("at", pa.int32()), ("stop", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pairs, made = None, [], None
        for whole in batches:
            for batch in (whole.slice(i, AT_ONCE) for i in range(0, whole.num_rows, AT_ONCE)):
                texts, found = [], []
                for i, (b, alias, term, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "alias", "term", "text")))):
                    if b != block:
                        block, pairs, made = b, [], None
                    if alias is not None:
                        pairs.append((alias, term))
                    elif pairs:
                        made = made or automaton(pairs)
                        if hits := taken(made, pairs, text):
                            texts.append(i)
                            found.append(hits)
                if texts:
                    held = batch.select(columns).take(pa.array(texts))
                    yield pa.RecordBatch.from_arrays([*held.columns, pa.array(found, spans)], names=[*columns, "h"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(find, f"{kinds}, h array<struct<alias:string,term:string,at:int,stop:int>>")
