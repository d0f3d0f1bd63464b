"""One row to many from SQL: chunking as functions to call in ``FROM``.

::

    register(spark)
    SELECT doc_id, c.* FROM (SELECT doc_id, fixed_chunks(text, 1500, 1300, 300) AS chunks FROM documents) AS d, LATERAL inline(d.chunks) AS c
    SELECT * FROM sentence_chunks(TABLE(SELECT doc_id, bounded_sentences(text) AS parts FROM documents), 'parts')

What the JVM can express is a SQL function that returns an array: the optimiser inlines it, and
``inline`` (which takes it as a column) runs where its row is, while a SQL function that returns a
table would be joined back on the whole text.  Only packing, which depends on sums along a text, is a Python table
function, of one text at a time and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import UserDefinedTableFunction

from granum.operators import documents as D


@dataclass
class _Columns(AnalyzeResult):
    """A result's columns with where the table holds its sentences and the others."""

    at: int = 0
    others: list[int] = field(default_factory=list)


class SentenceChunks:
    """``sentence_chunks(TABLE(..), 'parts')``: the table's other columns, ``chunk_index`` and ``text``.

    ``parts`` is an array of sentences; a null or empty one gives no row.  Columns of the
    table may not be called like the results.
    """

    def __init__(self, held: _Columns | None = None) -> None:
        self.at, self.others = (held.at, held.others) if held is not None else (0, [])

    @staticmethod
    def analyze(rows: AnalyzeArgument, parts: AnalyzeArgument) -> _Columns:
        """The result's columns; what is wrong with a call is an error before anything runs."""
        if not rows.isTable:
            raise ValueError("sentence_chunks: the first argument is TABLE(..)")
        names = [f.name for f in rows.dataType.fields]
        if parts.isTable or parts.value not in names:
            raise ValueError(f"sentence_chunks: the second argument names one of {names}")
        kind = rows.dataType[parts.value].dataType
        if names.count(parts.value) > 1 or not isinstance(kind, ArrayType) or not isinstance(kind.elementType, StringType):
            raise ValueError(f"sentence_chunks: {parts.value} is to be one array of strings")
        if {"chunk_index", "text"} & (set(names) - {parts.value}):
            raise ValueError("sentence_chunks: columns chunk_index and text are those of the result")
        at = names.index(parts.value)
        schema = StructType([f for f in rows.dataType.fields if f.name != parts.value]).add("chunk_index", IntegerType()).add("text", StringType())
        return _Columns(schema, at=at, others=[i for i in range(len(names)) if i != at])

    def eval(self, row: Row, parts: str) -> Iterator[tuple]:  # noqa: ARG002
        """The chunks of one row."""
        kept = tuple(row[i] for i in self.others)
        for k, text in enumerate(D.pack_sentences(row[self.at] or [])):
            yield (*kept, k, text)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> UserDefinedTableFunction:
    """Make ``fixed_chunks``, ``bounded_sentences`` and ``sentence_chunks`` known to the session's SQL."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION fixed_chunks(body STRING, width INT, stride INT, least INT) RETURNS ARRAY<STRUCT<chunk_index: INT, text: STRING>>
        RETURN filter(transform(CASE WHEN length(body) > 0 THEN sequence(0, length(body) - 1, stride) END, (s, k) -> named_struct('chunk_index', k, 'text', substr(body, s + 1, width))),
            c -> c.chunk_index = 0 OR length(c.text) >= least)""")
    joined, split, trimmed = D.sentence_patterns()
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION bounded_sentences(body STRING) RETURNS ARRAY<STRING>
        RETURN flatten(transform(filter(transform(split(regexp_replace(coalesce(body, ''), {_quoted(joined)}, ' '), {_quoted(split)}), p -> regexp_replace(p, {_quoted(trimmed)}, '')), p -> p <> ''),
            p -> transform(sequence(0, length(p) - 1, {D.MAXIMUM}), s -> substr(p, s + 1, {D.MAXIMUM}))))""")
    return spark.udtf.register("sentence_chunks", udtf(SentenceChunks))
